"""Operators: each takes a DataFrame and returns a DataFrame; none runs a job by itself, but those
that write (`write_*`)."""

from rankloom.operators.bitmaps import distinct_in, write_bitmaps
from rankloom.operators.clean import apply_corrections, clean, distinct_rows
from rankloom.operators.counts import column_ranges, counts, distinct_entities, totals
from rankloom.operators.features import binned_feature_points, feature_points, histogram
from rankloom.operators.hierarchy import hierarchy, hierarchy_json, hierarchy_lines, hierarchy_nodes, tree_lines, write_tree
from rankloom.operators.increments import add_batch, merged_counts, merged_totals
from rankloom.operators.positions import page_at, read_positions, write_positions
from rankloom.operators.question_sums import question_sums, write_question_sums
from rankloom.operators.rules import classify_by_rules
from rankloom.operators.shares import ranked_share, stack_positions, stack_segments
from rankloom.operators.tables import page, search, sort_table
from rankloom.operators.top import top_k, top_k_per_period, top_k_rows, top_k_with_ties
from rankloom.operators.trigrams import search_index, write_search_index
from rankloom.operators.words import word_counts

__all__ = [
    "add_batch",
    "apply_corrections",
    "binned_feature_points",
    "classify_by_rules",
    "clean",
    "column_ranges",
    "counts",
    "distinct_entities",
    "distinct_in",
    "distinct_rows",
    "feature_points",
    "hierarchy",
    "hierarchy_json",
    "hierarchy_lines",
    "hierarchy_nodes",
    "histogram",
    "merged_counts",
    "merged_totals",
    "page",
    "page_at",
    "question_sums",
    "ranked_share",
    "read_positions",
    "search",
    "search_index",
    "sort_table",
    "stack_positions",
    "stack_segments",
    "top_k",
    "top_k_per_period",
    "top_k_rows",
    "top_k_with_ties",
    "totals",
    "tree_lines",
    "word_counts",
    "write_bitmaps",
    "write_positions",
    "write_question_sums",
    "write_search_index",
    "write_tree",
]
