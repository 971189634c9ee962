"""The registered queries of this subpackage and the SQL that states the same result, where there is one."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import anchors, block_search, cross_polytope, impact_search, line_dedup, line_rules, mixing, ngram_join, sharded_lloyd
from .anchors import op5_difference_cover
from .block_search import op8_block_pruning
from .cross_polytope import op13_cross_polytope
from .html_lstm import op7_block_labeller
from .impact_search import op11_impact_search
from .lattice_lm import op6_lattice_likelihood
from .line_dedup import op10_line_join
from .line_rules import op3_line_frequency
from .mixing import op9_source_mixing
from .ngram_join import op4_ngram_jaccard
from .packing import op2_vector_packing
from .quality_fm import op1_quality_fm
from .sharded_lloyd import op12_sharded_lloyd

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (
        op1_quality_fm, op2_vector_packing, op3_line_frequency, op4_ngram_jaccard, op5_difference_cover, op6_lattice_likelihood,
        op7_block_labeller, op8_block_pruning, op9_source_mixing, op10_line_join,
        op11_impact_search, op12_sharded_lloyd, op13_cross_polytope)
}
ORACLES: dict[str, str] = {
    "op3_line_frequency": line_rules.ORACLE, "op4_ngram_jaccard": ngram_join.ORACLE, "op5_difference_cover": anchors.ORACLE,
    "op8_block_pruning": block_search.ORACLE, "op9_source_mixing": mixing.ORACLE, "op10_line_join": line_dedup.ORACLE,
    "op11_impact_search": impact_search.ORACLE, "op12_sharded_lloyd": sharded_lloyd.ORACLE,
    "op13_cross_polytope": cross_polytope.ORACLE}
