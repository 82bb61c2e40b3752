"""Queries over tree-shaped payloads, sections and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.chunking import chunk_documents, sections, text_spans
from tidewright.operators.trees import flatten_blocks, flatten_trees
from tidewright.plans.registry import query, table


@query("""with l as (select doc_id, string_split(text, '\n') w from documents) select doc_id, array_to_string(list_transform(w, lambda x, i: case when i % 3 = 0 then x || chr(10) || chr(10) || chr(10) when i % 3 = 1 then x || chr(10) || chr(10) else x || chr(10) end), '') as text from l""")
def p07_document_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as trees of paragraphs, some in quotes or in list items of quotes, flattened to text again."""
    node = lambda kind, inner: F.concat(F.lit(f'{{"type":"{kind}","content":['), inner, F.lit("]}"))
    said = lambda x: F.concat(F.lit('{"type":"text","text":'), F.substring(F.to_json(F.array(x)), 2, 100_000_000), F.lit("}"))
    leaf = lambda x: F.concat(F.substring(said(x), 1, F.length(said(x)) - 2), F.lit("}"))
    line = lambda x, i: F.when((i + 1) % 3 == 0, node("blockquote", node("listItem", node("paragraph", leaf(x))))).when((i + 1) % 3 == 1, node("panel", node("paragraph", leaf(x)))).otherwise(node("heading", leaf(x)))
    trees = table(spark, sf_dir, "documents").select("doc_id", node("doc", F.array_join(F.transform(F.split("text", "\n"), line), ",")).alias("body"))
    return flatten_trees(trees, "doc_id", "body")


@query("""with l as (select doc_id, list_transform(string_split(text, '\n'), lambda x, i: case when x = '' then null when i % 4 = 0 then '- ' || x when i % 4 = 1 then x when i % 4 = 2 then chr(10) || x else '```' || chr(10) || x || chr(10) || '```' end) w from documents) select doc_id, array_to_string(list_filter(w, lambda x: x is not null), chr(10)) as text from l""")
def p08_block_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lists of blocks of four kinds, flattened to text again."""
    kinds = F.array(*map(F.lit, ["bulleted_list_item", "paragraph", "heading_2", "code"]))
    block = lambda x, i: (lambda k: F.to_json(F.map_from_arrays(F.array(F.lit("type"), k), F.array(k, F.to_json(F.struct(F.array(F.struct(x.alias("plain_text"))).alias("rich_text")))))))(F.get(kinds, (i + 1) % 4))
    # A block's payload is an object, not a string of one.
    bare = lambda b: F.regexp_replace(F.regexp_replace(b, r':"\\{', ":{"), r'\\}"\\}$', "}}")
    listed = F.transform(F.split("text", "\n"), lambda x, i: block(x, i))
    made = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("blocks"))
    return made.select("doc_id", flatten_blocks(F.col("blocks")).alias("text"))


_HEADED = "case when i % 5 = 1 then '## Part ' || i || chr(10) || x when i % 5 = 3 then '### Point ' || i || chr(10) || x else x end"


@query(f"""with l as (select doc_id, unnest(string_split(text, '\n')) x, generate_subscripts(string_split(text, '\n'), 1) i from documents), h as (select doc_id, i, i % 5 = 1 as part, i % 5 = 3 as point from l where i % 5 in (1, 3)) select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as section, case when part then 2 else 3 end as level, case when part then 'Part ' || i else 'Part ' || (i - 2) || ' > Point ' || i end as path from h""")
def x48_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents with headings put into their lines: number, level and path."""
    line = lambda x, i: F.when((i + 1) % 5 == 1, F.concat(F.lit("## Part "), i + 1, F.lit("\n"), x)).when((i + 1) % 5 == 3, F.concat(F.lit("### Point "), i + 1, F.lit("\n"), x)).otherwise(x)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))
    return sections(docs).select("doc_id", "section", "level", F.array_join("path", " > ").alias("path"))


@query()
def x48_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and sentences of every document with their offsets."""
    return text_spans(table(spark, sf_dir, "documents"))


@query()
def x47_heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that never mix sections, of documents whose longer lines are headings."""
    line = lambda x: F.when(F.length(x) > 120, F.concat(F.lit("# "), x)).otherwise(x)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))
    return chunk_documents(docs, 400, 60, headings=True)
