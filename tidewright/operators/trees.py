"""Text of tree-shaped payloads: document trees of any depth, and lists of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.graph import shared_table

# Nodes of a tree that end a line.
BLOCKS = ("paragraph", "heading", "listItem", "blockquote", "codeBlock", "panel")
#: Levels that one stored step takes; a node and the list of its content are one.
STEP = 5


def flatten_trees(payloads: DataFrame, id_: str, body: str) -> DataFrame:
    """``id_`` and text of JSON document trees: text nodes in order, a line end for hard breaks and behind blocks.

    A document stays one row: its list of pieces and open nodes, in order, in which
    every open node gives way to its piece or its children, level by level.  Nothing
    is shuffled.  Null, broken or empty trees give an empty text; strings stand for
    themselves, numbers and nodes of unknown kinds for their content alone.
    """
    none = F.array().cast("array<struct<piece:string,node:variant>>")
    item = lambda piece, node: F.struct(piece.cast("string").alias("piece"), node.cast("variant").alias("node"))
    nothing = F.lit(None)

    def grown(x: Column) -> Column:
        node = x["node"]
        value = lambda p: F.try_variant_get(node, p, "string")
        listed, type_, content = F.try_variant_get(node, "$", "array<variant>"), value("$.type"), F.try_variant_get(node, "$.content", "variant")
        # The kind of a whole subtree is dear, so only what has no parts is asked for it.
        bare = listed.isNull() & type_.isNull() & content.isNull() & (F.schema_of_variant(node) == "STRING")
        own = F.when(type_ == "text", F.coalesce(value("$.text"), F.lit(""))).when(type_ == "hardBreak", "\n").when(bare, value("$"))
        inner = F.coalesce(listed, F.try_variant_get(node, "$.content", "array<variant>"), F.array(content))
        children = F.transform(F.filter(inner, lambda c: c.isNotNull()), lambda c: item(nothing, c))
        ends = F.when(type_.isin(*BLOCKS), F.array(item(F.lit("\n"), nothing))).otherwise(none)
        return F.when(node.isNull(), F.array(x)).when(own.isNotNull(), F.array(item(own, nothing))).otherwise(F.concat(children, ends))

    tree = F.try_parse_json(F.col(body))
    level = payloads.select(F.col(id_).alias("id"), F.when(tree.isNotNull(), F.array(item(nothing, tree))).otherwise(none).alias("items"))
    texts = None
    while True:
        for _ in range(STEP):
            level = level.select("id", F.flatten(F.transform("items", grown)).alias("items"))
        # Variants are stored as JSON, so that any reader can take the level up again.
        stored = shared_table(level.select("id", F.transform("items", lambda x: F.struct(x["piece"].alias("piece"), F.to_json(x["node"]).alias("json"))).alias("items")), "tree-level")
        unfinished = F.exists("items", lambda x: x["json"].isNotNull())
        done = stored.filter(~unfinished).select(F.col("id").alias(id_), F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("text"))
        texts = done if texts is None else texts.unionByName(done)
        rest = stored.filter(unfinished)
        if rest.isEmpty():
            return texts
        level = rest.select("id", F.transform("items", lambda x: item(x["piece"], F.parse_json(x["json"]))).alias("items"))


def flatten_blocks(blocks: Column) -> Column:
    """Text of a JSON list of blocks, a line each: the plain text of the runs under a block's kind, marked by the kind; blocks without text are left out."""
    listed = F.from_json(blocks, "array<map<string,string>>")

    def line(block: Column) -> Column:
        kind = F.coalesce(block["type"], F.lit(""))
        runs = F.from_json(F.element_at(block, kind), "struct<rich_text: array<struct<plain_text: string>>>")["rich_text"]
        text = F.array_join(F.transform(runs, lambda r: F.coalesce(r["plain_text"], F.lit(""))), "")
        marked = F.when(kind == "bulleted_list_item", F.concat(F.lit("- "), text)).when(kind == "numbered_list_item", F.concat(F.lit("1. "), text)).when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```"))).when(kind.startswith("heading"), F.concat(F.lit("\n"), text)).otherwise(text)
        return F.when(text != "", marked)

    return F.coalesce(F.array_join(F.filter(F.transform(listed, line), lambda x: x.isNotNull()), "\n"), F.lit(""))
