import duckdb
import oracle
import pyarrow as pa
from pyspark.sql import functions as F

from wayloom.functions import wikitext as wt
from wayloom.functions.wikitext import clean, resolve_links, sections_of, strip_braces
from wayloom.plans.registry import ORACLE_SQL, QUERIES


def test_braces():
    assert strip_braces("a{{b{{c}}d}}e") == "ae"
    assert strip_braces("a}}b{|c|}d") == "a}}bd"
    assert strip_braces("a{{b") == "a"


def test_links():
    assert resolve_links("x [[A|b]] [[C]] y") == "x b C y"
    assert resolve_links("[[File:p.png|a [[l]] b]]z") == "z"
    assert resolve_links("a [[b") == "a [[b"
    assert resolve_links("[http://h lab el] [//h]") == "lab el "
    assert resolve_links("[[A|x [[B]] y]] ]] [[C|]]") == "x B y ]] C"
    assert resolve_links("[[a [[b]] c]] [[T|[[file:f]]]]") == "a [[b]] c T"


def test_lines_and_sections():
    assert clean("* a\n\n\n\n\nb  c\n| t\n! u") == "a\n\nb c"
    got = sections_of("lead\n== H ==\ntext\n===E===\n\n====Z====\nz")
    assert got == {"lead": "lead", "sections": [{"level": 2, "title": "H", "text": "text"}, {"level": 4, "title": "Z", "text": "z"}]}


def test_steps_in_the_jvm_are_those_of_the_whole(spark):
    """Texts without templates and links: the two native steps give what the cleaner gives."""
    texts = ["", "plain", "<!-- a\nb -->x<REF name='q'>r\n</ref>y<ref/>'''z'''", "* a\n# b\n;; c\n| d\n{| e\n  ! f\n|}\n\n\n\n\ng \t h ", "<small>a</small><br/>b<div class=c>d</div>", "\n\n \n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", wt.clean_lines(wt.strip_comments_refs_tags(F.col("t"))).alias("native")).collect()
    assert [r.native for r in rows] == [wt.clean(r.t) for r in rows]


def test_sections_of_many_texts_come_in_small_batches(spark):
    """3 000 texts of 10 kB in one task: what Python hands back at once is bounded by bytes, not by rows."""
    body = "ab cd " * 1700
    texts = spark.range(3000).coalesce(1).select("id", F.when(F.col("id") != 5, F.concat(F.col("id").cast("string"), F.lit(f"{body}\n== H ==\n{body}"))).alias("text"))
    parsed = wt.split_sections(texts)
    sizes = parsed.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")
    r = {r.id: r.a for r in parsed.where("id IN (5, 7)").collect()}
    assert sizes.agg(F.sum("n")).first()[0] == 3000 and r[5].lead == "" and r[5].sections == [] and r[7].lead == ("7" + body).strip() and r[7].sections[0].text == body.strip()
    run = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in run and "ArrowEvalPython" not in run


def test_sections_round_texts_without_letters_and_nulls_are_those_of_the_sql(spark, tmp_path):
    texts = ["", "  ", "123 — 雨!", None, "a", "it's  two\nlines", " �b ", "éè", "{{c [[d", None]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert oracle.difference(QUERIES["split_sections"](spark, str(tmp_path)), ORACLE_SQL["split_sections"], db) is None
