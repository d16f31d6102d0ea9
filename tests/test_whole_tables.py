"""Queries over pairs and walks take all rows of larger tables, as their SQL does."""

import pytest

from millrace.registry import QUERIES, SQL
from tests.oracle import same


@pytest.mark.parametrize("name", ["e28_colorways", "s18_listing_steps", "j20_best_rule", "j14_code_in_sku", "j16_token_overlap", "j17_weighted_score", "w02_dedupe_any_key"])
def test_all_rows(spark, name):
    same(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.01")


ROW_PAIRS = """with t as (select p_partkey as id, list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' '), lambda w: length(w) > 1)) as w from part), a as (select * from t where id % 2 = 0), b as (select * from t where id % 2 = 1)
    select a.id as left_id, b.id as right_id, len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) as overlap from a, b where len(list_intersect(a.w, b.w)) >= 0.55 * least(len(a.w), len(b.w)) and len(a.w) > 0 and len(b.w) > 0"""


def _row_pairs(spark, sf_dir):
    """All pairs of parts, from the pairs of sets and the members that the query returns."""
    out = QUERIES["j16_token_overlap"](spark, sf_dir)
    left, right = (out.where(f"id is not null and {side}_set is not null").select(f"{side}_set", out.id.alias(f"{side}_id")) for side in ("left", "right"))
    return out.where("id is null").drop("id").join(left, "left_set").join(right, "right_set").select("left_id", "right_id", "overlap")


def test_token_overlap_names_every_pair_of_parts(spark):
    same(spark, _row_pairs, ROW_PAIRS, "/root/testdata/sf0.01")


def test_token_overlap_of_odd_parts(spark, tmp_path):
    """Copies, the same words in another order, null columns and keys, parts without words, negative keys."""
    parts = [(2, "red cup", "tin", "b"), (4, "cup red", "tin", "b"), (3, "tin red", "cup", "b"), (5, "red cup", "tin", "b"), (7, "red cup", None, "b"), (8, None, "red tin", "b"), (9, "a b", "c", "d"), (-3, "red cup", "tin", "b"), (-4, "red cup", "jar", "b"), (None, "red cup", "tin", "b")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string").coalesce(1).write.parquet(str(tmp_path / "rows"))
    next((tmp_path / "rows").glob("*.parquet")).rename(tmp_path / "part.parquet")
    same(spark, _row_pairs, ROW_PAIRS, str(tmp_path))
    for name in ("j16_token_overlap", "j16_token_links"):
        same(spark, QUERIES[name], SQL[name], str(tmp_path))
