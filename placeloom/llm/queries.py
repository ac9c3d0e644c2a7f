"""Queries of this subpackage: name -> function of (spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from .alignment import op12_merge_path
from .bpe import op10_bpe_replay
from .exact_dedup import SQL as EXACT_SQL
from .exact_dedup import op2_exact_dedup
from .fingerprints import op13_simhash_blocks
from .hmm import op7_hmm_scores
from .kneser_ney import op5_kneser_ney_quality
from .licences import licence_lines, lines_sql, op6_licence_digests
from .licences import sql as licence_sql
from .mixing import op3_curriculum_mix
from .prefix_trie import op11_prefix_trie
from .quality_rules import op9_host_rules
from .repair import op1_repair_shards
from .sharding import op8_bounded_ring
from .simhash import op4_simhash_pivots


def queries():
    found = (op1_repair_shards, op2_exact_dedup, op3_curriculum_mix, op4_simhash_pivots, op5_kneser_ney_quality, op6_licence_digests, op7_hmm_scores, op8_bounded_ring, op9_host_rules, op10_bpe_replay, op11_prefix_trie, op12_merge_path, op13_simhash_blocks)
    return {f.__name__: f for f in found} | {"llm_licence_lines": licence_lines}


def oracle_sql():
    return {"op2_exact_dedup": EXACT_SQL, "op6_licence_digests": licence_sql(), "llm_licence_lines": lines_sql()}
