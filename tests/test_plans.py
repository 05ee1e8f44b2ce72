"""Physical-plan checks for the scale claims in the README."""

from contentfit.operators import sections as sx
from contentfit.plans import catalog as C
from contentfit.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_thresholded_match_plan(spark):
    df = C.lexical_fit(spark, SF)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    # Without repeated rows, which are looked for by keys and a hash, the joins with them fall away.
    assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final
    assert final.count("hashpartitioning") <= 1          # one shuffle: the partial aggregate's


def test_scan_prunes_columns(spark):
    qe = C.lexical_fit(spark, SF)._jdf.queryExecution().toString()
    assert "struct<doc_id:bigint,text:string>" in qe and "lang" not in qe.split("ReadSchema")[1][:200]


def test_top_k_plan(spark):
    p = plan(C.top_clicks(spark, SF))
    assert "TakeOrderedAndProject" in p
    assert "Window" not in p


def test_section_extraction_is_map_only(spark):
    p = plan(sx.page_sections(read_table(spark, SF, "pages", ["page_id", "url", "html"])))
    assert "Exchange" not in p and "Generate" in p


def test_no_inferred_filter_on_vectors(spark):
    # explode_outer + filter keeps the vector code out of an inferred filter
    qe = C.lexical_fit(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "size(CASE WHEN" not in qe
