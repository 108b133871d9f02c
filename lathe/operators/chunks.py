"""Chunks of two levels. Level 1: sections and tables, merged and cut by token limits. Level 2: parts of them by rule.

A chunk's key is (document_id, chunk_ord); ids may repeat as the rules give them. Columns: CHUNK.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lathe.functions import text as X
from lathe.operators import tables as TB
from lathe.operators.lines import by_line, doc_lines, ordered
from lathe.plans.rules import Schema

STRINGS, INTS, LISTS = T.StringType(), T.IntegerType(), T.ArrayType(T.StringType())
#: Chunk metadata is a closed struct, so filters on single fields reach the Parquet scan; an absent key is null.
METADATA = T.StructType([T.StructField(name, kind) for name, kind in (
    ("heading", STRINGS), ("heading_level", INTS), ("heading_path", STRINGS), ("page_range", STRINGS), ("effective_date", STRINGS), ("container_types", LISTS), ("service_type", STRINGS), ("unit", STRINGS),
    ("applies_to", LISTS), ("references", LISTS), ("article_number", STRINGS), ("chapter_number", STRINGS), ("section_number", STRINGS), ("authority", STRINGS), ("scope", STRINGS), ("table_id", STRINGS),
    ("row_count", INTS), ("column_count", INTS), ("table_type", STRINGS), ("container_columns", T.MapType(T.StringType(), T.IntegerType())), ("parent_chunk_id", STRINGS), ("container_type", STRINGS),
    ("rule_type", STRINGS), ("clause_number", STRINGS), ("term", STRINGS), ("condition_type", STRINGS),
)])
RELATION = "array<struct<type:string,target_chunk_id:string,description:string,confidence:double>>"
CHUNK = ("document_id", "chunk_ord", "chunk_id", "level", "type", "title", "content", "metadata", "relationships", "headers", "rows", "token_count")


def closed(values: dict[str, Column], base: Column | None = None) -> Column:
    """The metadata struct with given values; others from base or null."""
    def one(f):
        if f.name in values:
            v = values[f.name]
            return v.cast(f.dataType).alias(f.name)
        return (base[f.name] if base is not None else F.lit(None).cast(f.dataType)).alias(f.name)

    return F.struct(*(one(f) for f in METADATA.fields))


def from_schema(text: str, schema: Schema, context: Column, strict: bool) -> dict[str, Column]:
    got = X.metadata(text, schema, context, strict)
    known = {f.name for f in METADATA.fields}
    return {name: got[name] for name in schema.fields if name in known and (name in schema.extractors or name in X.COMMON_FIELDS)}


def heading(line: Column | str, schema: Schema) -> Column:
    """PRD4: struct of text, level and type of the first marker that matches, else null."""
    line = X.col(line)
    stripped = X.strip(line)
    kind = None
    for name, pattern in schema.markers():
        hit = stripped.rlike("(?U)" + pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    level = F.when(F.startswith(line, F.lit("#")), F.length(F.regexp_extract(line, "^(#+)", 1))).when(line.rlike(r"^I+\."), 1).when(line.rlike(r"^\d+\."), 2).otherwise(1)
    if kind is None:
        return F.lit(None).cast("struct<text:string,level:int,type:string>")
    return F.when(kind.isNotNull(), F.struct(stripped.alias("text"), level.alias("level"), kind.alias("type")))


def sections(lines: DataFrame, schema: Schema) -> DataFrame:
    """CHK2: document_id, section_idx, heading (struct or null), content lines; headings without lines are dropped. lines: table_lines()."""
    marked = lines.where("table is null").withColumn("head", heading("line", schema))
    marked = marked.withColumn("no", F.count("head").over(by_line().rowsBetween(W.unboundedPreceding, 0)))
    found = marked.groupBy("document_id", "no").agg(F.first("head", ignorenulls=True).alias("heading"), F.filter(ordered(F.when(F.col("head").isNull(), F.col("line"))), lambda x: x.isNotNull()).alias("content_lines"))
    found = found.where(F.size("content_lines") > 0)
    return found.withColumn("section_idx", F.row_number().over(W.partitionBy("document_id").orderBy("no")) - 1).drop("no")


def section_chunks(found: DataFrame, schema: Schema, strict: bool = True, tokenizer=None) -> DataFrame:
    """CHK3."""
    rows = found.withColumn("content", X.strip(F.array_join("content_lines", "\n"))).where("content <> ''")
    head = F.coalesce(F.col("heading.text"), F.lit(""))
    meta = from_schema("content", schema, head, strict) | {"heading": F.col("heading.text"), "heading_level": F.col("heading.level")}
    kind = F.when(F.contains(head, F.lit("Điều")), "article").when(F.contains(head, F.lit("Chương")), "chapter").otherwise("section")
    return rows.select(
        "document_id", F.lit(0).alias("part"), F.col("section_idx").alias("idx"), F.concat_ws("_", "document_id", F.lit("section"), F.col("section_idx").cast("string")).alias("chunk_id"), kind.alias("type"),
        F.coalesce(F.col("heading.text"), F.concat(F.lit("Section "), F.col("section_idx").cast("string"))).alias("title"), "content", closed(meta).alias("metadata"),
        F.lit(None).cast("array<string>").alias("headers"), F.lit(None).cast("array<array<string>>").alias("rows"), X.count_tokens("content", tokenizer).alias("token_count"),
    )


def table_chunks(tables: DataFrame, schema: Schema, strict: bool = True, tokenizer=None) -> DataFrame:
    """CHK4."""
    near = F.array_join(F.reverse(F.slice(F.reverse(F.split(X.strip("context_before"), "\n")), 1, 3)), "\n")
    parts = F.array_compact(F.array(F.when(F.col("context_before") != "", F.concat(near, F.lit("\n"))), F.when(F.col("caption").isNotNull(), F.concat(F.lit("**"), F.col("caption"), F.lit("**\n"))), TB.to_markdown()))
    rows = tables.withColumn("content", F.array_join(parts, "\n")).withColumn("name", F.concat(F.lit("table_"), F.col("table_idx").cast("string")))
    meta = from_schema("content", schema, F.col("context_before"), strict) | {
        "table_id": F.coalesce("table_id", "name"), "row_count": F.col("row_count"), "column_count": F.col("column_count"), "table_type": F.col("table_type"),
        "container_columns": F.when(F.size("container_columns") > 0, F.col("container_columns")),
    }
    suffix = F.coalesce(F.lower(F.replace("table_id", F.lit(" "), F.lit("_"))), F.col("name"))
    return rows.select(
        "document_id", F.lit(1).alias("part"), F.col("table_idx").alias("idx"), F.concat_ws("_", "document_id", suffix).alias("chunk_id"), F.lit("table").alias("type"),
        F.coalesce("caption", "table_id", F.concat(F.lit("Table "), F.col("table_idx").cast("string"))).alias("title"), "content", closed(meta).alias("metadata"), "headers", "rows", X.count_tokens("content", tokenizer).alias("token_count"),
    )


def merge_small(chunks: DataFrame, least: int, most: int, keys=("document_id",), order: str = "ord") -> DataFrame:
    """CHK5, CHK6: a chunk under the least with a successor of its type takes it in, if both fit; each chunk once.

    The greedy scan in sets: runs of chunks that could merge; the merges start at their odd places.
    """
    w = W.partitionBy(*keys).orderBy(order)
    can = (F.col("token_count") < least) & (F.col("token_count") + F.lead("token_count").over(w) <= most) & (F.col("type") == F.lead("type").over(w))
    rows = chunks.withColumn("__n", F.row_number().over(w)).withColumn("__can", F.coalesce(can, F.lit(False)))
    flagged = W.partitionBy(*keys, "__can").orderBy(order)
    rows = rows.withColumn("__run", F.col("__n") - F.row_number().over(flagged))
    place = F.row_number().over(W.partitionBy(*keys, "__can", "__run").orderBy(order))
    rows = rows.withColumn("starts", F.col("__can") & (place % 2 == 1))
    rows = rows.withColumn("taken", F.coalesce(F.lag("starts").over(w), F.lit(False)))
    return rows.drop("__n", "__can", "__run")


def budget_starts(tokens: Column, most: int) -> Column:
    """CHK7: the places (from 1) of the paragraphs that begin a group, when they are packed in order into the budget; none is cut.

    Only a group's beginning is added to the result: adding to an array copies it, and there are far fewer groups than paragraphs."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc, t):
        new = (acc["n"] == 0) | (acc["total"] + t > most)
        n = acc["n"] + 1
        return F.struct(F.when(new, t.cast("long")).otherwise(acc["total"] + t).alias("total"), n.alias("n"), F.when(new, F.concat(acc["out"], F.array(n))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(tokens, zero, step, lambda acc: acc["out"])


def split_large(chunks: DataFrame, most: int, separator: str = "\n\n", tokenizer=None) -> DataFrame:
    """Chunks over the limit cut at paragraphs: piece_no (from 0), pieces, piece, piece_tokens; others have piece_no null."""
    paragraphs = F.split("content", separator, -1)
    cut = chunks.withColumn("__p", F.when(F.col("token_count") > most, paragraphs))
    tokens = F.transform("__p", lambda p: X.count_tokens(p, tokenizer))
    cut = cut.withColumn("__t", tokens).withColumn("__s", budget_starts(F.col("__t"), most))

    def piece(start, no):
        n = F.coalesce(F.get("__s", no + 1), F.size("__p") + 1) - start
        return F.struct(no.alias("no"), F.size("__s").alias("of"), F.array_join(F.slice("__p", start, n), separator).alias("text"), F.aggregate(F.slice("__t", start, n), F.lit(0).cast("long"), lambda a, t: a + t).alias("tokens"))

    pieces = F.when(F.col("__p").isNotNull(), F.transform("__s", piece))
    return cut.withColumn("piece", F.explode_outer(pieces)).drop("__p", "__t", "__s")


def level_one(docs: DataFrame, schema: Schema, strict: bool = True, tokenizer=None) -> DataFrame:
    """CHK1: sections, then tables, adjusted to the limits. docs: document_id, text."""
    lines = TB.table_lines(doc_lines(docs))
    found = section_chunks(sections(lines, schema), schema, strict, tokenizer).unionByName(table_chunks(TB.tables_of(lines), schema, strict, tokenizer))
    # metadata goes flat through the windows, so that fields nobody asks for aren't computed
    flat = {f.name: f"m_{f.name}" for f in METADATA.fields}
    found = found.select(*(c for c in found.columns if c != "metadata"), *(F.col("metadata")[name].alias(c) for name, c in flat.items()))
    w = W.partitionBy("document_id").orderBy("part", "idx")
    rows = merge_small(found.withColumn("ord", F.row_number().over(w) - 1), schema.limit("first_min"), schema.limit("first_max"))
    w = W.partitionBy("document_id").orderBy("ord")
    nxt = {c: F.lead(c).over(w) for c in ("content", "title", *flat.values())}
    both = F.col("starts")
    content = F.when(both, F.concat("content", F.lit("\n\n"), nxt["content"])).otherwise(F.col("content"))
    meta = [F.when(both, F.coalesce(nxt[c], F.col(c))).otherwise(F.col(c)).alias(c) for c in flat.values()]
    merged = rows.select(
        "document_id", "ord", "taken", "starts", F.when(both, F.concat("chunk_id", F.lit("_merged"))).otherwise(F.col("chunk_id")).alias("chunk_id"), "type", F.when(both, F.concat("title", F.lit(" & "), nxt["title"])).otherwise(F.col("title")).alias("title"),
        content.alias("content"), *meta, F.when(~both, F.col("headers")).alias("headers"), F.when(~both, F.col("rows")).alias("rows"), "token_count",
    ).where("not taken")
    merged = merged.withColumn("token_count", F.when(F.col("starts"), X.count_tokens("content", tokenizer)).otherwise(F.col("token_count")))
    most = schema.limit("first_max")
    cut = split_large(merged.withColumn("__whole", F.col("token_count")).withColumn("token_count", F.when(F.col("starts"), 0).otherwise(F.col("token_count"))), most, tokenizer=tokenizer)
    part = F.col("piece").isNotNull()
    no = (F.col("piece.no") + 1).cast("string")
    titled = F.when(part & (F.col("piece.of") > 1), F.concat("title", F.lit(" (Part "), no, F.lit(")"))).otherwise(F.col("title"))
    out = cut.select(
        "document_id", "ord", "piece.no", F.when(part, F.concat("chunk_id", F.lit("_part"), no)).otherwise(F.col("chunk_id")).alias("chunk_id"), F.lit(1).alias("level"), "type", titled.alias("title"),
        F.when(part, F.col("piece.text")).otherwise(F.col("content")).alias("content"), *flat.values(), F.array().cast(RELATION).alias("relationships"), F.when(~part, F.col("headers")).alias("headers"), F.when(~part, F.col("rows")).alias("rows"),
        F.when(part, F.col("piece.tokens")).otherwise(F.col("__whole")).cast("int").alias("token_count"),
    )
    w = W.partitionBy("document_id").orderBy("ord", F.coalesce("no", F.lit(0)))
    meta = F.struct(*(F.col(c).alias(name) for name, c in flat.items()))
    return out.withColumn("chunk_ord", F.row_number().over(w) - 1).withColumn("metadata", meta).select(*CHUNK)


def clauses(text: Column | str, pattern: str) -> Column:
    """CHK12: pieces from each match to the next (array of struct number, text)."""
    p = pattern.removeprefix("^")
    anchor = "^" if pattern.startswith("^") else ""
    pieces = F.filter(F.split(X.col(text), f"(?mdU)(?={anchor}{p})", -1), lambda x: x.rlike(f"(?U)^(?:{p})"))
    return F.transform(pieces, lambda x, i: F.struct((i + 1).cast("string").alias("number"), X.strip(x).alias("text")))


def definitions(text: Column | str, pattern: str) -> Column:
    """CHK13: sentences with the marker, and the last three words before it."""
    hit = F.filter(X.sentences(text), lambda s: s.rlike(X.any_case(pattern)))
    before = lambda s: X.words(F.get(F.split(s, X.any_case(pattern), 2), F.lit(0)))
    return F.transform(hit, lambda s: F.struct(F.array_join(F.slice(before(s), F.greatest(F.size(before(s)) - 2, F.lit(1)), 3), " ").alias("term"), s.alias("text")))


def _row_text(headers: Column):
    return lambda row: F.array_join(F.transform(F.arrays_zip(headers.alias("h"), F.slice(row, 1, F.size(headers)).alias("c")), lambda z: F.when(z["c"].isNotNull(), F.concat(F.coalesce(z["h"], F.lit("")), F.lit(": "), z["c"]))), " | ")


def decomposed(schema: Schema) -> Column | None:
    """CHK8-14: the level-2 chunks of a level-1 chunk (array of struct chunk_id, type, title, content, key); null if the schema has no rule."""
    parts = []
    parent = F.col("chunk_id")
    empty = F.array().cast("array<struct<chunk_id:string,type:string,title:string,content:string,key:string>>")

    def made(kind, chunk_id, title, content, key):
        return F.struct(chunk_id.alias("chunk_id"), F.lit(kind).alias("type"), title.alias("title"), content.alias("content"), key.alias("key"))

    for of, rules in schema.decomposition.items():
        if of not in ("table", "section", "article", "clause"):
            continue
        for rule in rules:
            if of == "table" and rule["type"] == "row_group" and rule.get("group_by") == "container_size":
                def group(e):
                    data = F.filter("rows", lambda r: X.strip(F.coalesce(F.get(r, e["value"]), F.lit(""))) != "")
                    content = F.concat_ws("\n", F.concat(F.array(F.concat(F.lit("Container type: "), e["key"], F.lit("\n"))), F.transform(data, _row_text(F.col("headers")))))
                    clean = F.replace(F.replace(e["key"], F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))
                    return F.when(F.size(data) > 0, made("row_group", F.concat(parent, F.lit("_sub_row_"), clean), F.concat("title", F.lit(" - "), e["key"]), content, e["key"]))

                parts.append((of, F.array_compact(F.transform(F.map_entries(F.coalesce("metadata.container_columns", F.create_map().cast("map<string,int>"))), group))))
            elif of == "table" and rule["type"] == "rule":
                for p in rule["patterns"]:
                    hit = TB.matching_rows(F.col("rows"), p)
                    content = F.concat_ws("\n", F.concat(F.array(F.lit(f"Rule type: {rule['extract']}\n")), F.transform(hit, _row_text(F.col("headers")))))
                    one = made("rule", F.concat(parent, F.lit(f"_sub_{rule['extract']}_"), F.size(hit).cast("string")), F.concat("title", F.lit(f" - {rule['extract']}")), content, F.lit(rule["extract"]))
                    parts.append((of, F.when(F.size(hit) > 0, F.array(one)).otherwise(empty)))
            elif of != "table" and rule["type"] == "clause":
                found = F.concat(*(clauses("content", p) for p in rule["patterns"]))
                parts.append((of, F.transform(found, lambda c: made("clause", F.concat(parent, F.lit("_sub_clause_"), c["number"]), F.concat(F.lit("Khoản "), c["number"]), c["text"], c["number"]))))
            elif of != "table" and rule["type"] == "definition":
                found = F.concat(*(definitions("content", p) for p in rule["patterns"]))
                parts.append((of, F.transform(found, lambda d, i: made("definition", F.concat(parent, F.lit("_sub_def_"), i.cast("string")), F.concat(F.lit("Definition: "), d["term"]), d["text"], d["term"]))))
            elif of != "table" and rule["type"] == "condition":
                parts.append((of, F.transform(X.conditions("content"), lambda c, i: made("condition", F.concat(parent, F.lit("_sub_cond_"), i.cast("string")), F.concat(F.lit("Condition: "), c["type"]), c["text"], c["type"]))))
    if not parts:
        return None
    usable = lambda of: (F.col("type") == of) & (F.col("rows").isNotNull() if of == "table" else F.lit(True))
    return reduce(lambda a, b: F.concat(a, b), [F.when(usable(of), c).otherwise(empty) for of, c in parts])


def kept_of(c: Column, parent: Column) -> dict[str, Column]:
    """The metadata of a level-2 chunk."""
    key = lambda name: F.when(c["type"] == name, c["key"])
    return {"parent_chunk_id": parent, "container_type": key("row_group"), "rule_type": key("rule"), "clause_number": key("clause"), "term": key("definition"), "condition_type": key("condition")}


def relation_to(c: Column, parent: Column) -> Column:
    described = F.when(c["type"] == "row_group", F.lit("Parent table"))
    return F.array(F.struct(F.lit("parent").alias("type"), parent.alias("target_chunk_id"), described.alias("description"), F.lit(1.0).alias("confidence")))


def level_two(chunks: DataFrame, schema: Schema, tokenizer=None) -> DataFrame:
    """CHK8-14: level-2 chunks of level-1 chunks; chunk_ord counts on after the document's level-1 chunks."""
    every = decomposed(schema)
    if every is None:
        return chunks.where("false").select(*CHUNK)
    rows = chunks.withColumn("__last", F.max("chunk_ord").over(W.partitionBy("document_id"))).withColumn("__all", every)
    rows = rows.select("document_id", "__last", F.col("chunk_ord").alias("__from"), F.col("chunk_id").alias("__parent"), F.posexplode("__all").alias("__no", "c"))
    kind = F.col("c.type")
    meta, relation = closed(kept_of(F.col("c"), F.col("__parent"))), relation_to(F.col("c"), F.col("__parent"))
    ord_ = F.col("__last") + F.row_number().over(W.partitionBy("document_id").orderBy("__from", "__no"))
    return rows.select(
        "document_id", ord_.alias("chunk_ord"), "c.chunk_id", F.lit(2).alias("level"), kind.alias("type"), "c.title", "c.content", meta.alias("metadata"), relation.alias("relationships"),
        F.lit(None).cast("array<string>").alias("headers"), F.lit(None).cast("array<array<string>>").alias("rows"), X.count_tokens("c.content", tokenizer).alias("token_count"),
    ).select(*CHUNK)


def both_levels(chunks: DataFrame, schema: Schema, fields: tuple[str, ...]) -> DataFrame:
    """Level-1 chunks and their level-2 chunks in one pass: document_id, from (the level-1 chunk's chunk_ord), no (-1: that chunk itself), chunk_id, type, title, content, metadata (the given fields only), relationships."""
    every = decomposed(schema)
    whole = F.struct("chunk_id", "type", "title", "content", F.lit(None).cast("string").alias("key"))
    each = F.array(whole) if every is None else F.concat(F.array(whole), every)
    rows = chunks.select("document_id", F.col("chunk_ord").alias("from"), F.col("chunk_id").alias("__parent"), F.struct(*(F.col("metadata")[name].alias(name) for name in fields)).alias("__own"), F.posexplode(each).alias("__no", "c"))
    first, kept = F.col("__no") == 0, kept_of(F.col("c"), F.col("__parent"))
    meta = F.struct(*(F.when(first, F.col("__own")[f.name]).otherwise(kept[f.name].cast(f.dataType) if f.name in kept else F.lit(None).cast(f.dataType)).alias(f.name) for f in METADATA.fields if f.name in fields))
    relations = F.when(first, F.array().cast(RELATION)).otherwise(relation_to(F.col("c"), F.col("__parent")).cast(RELATION))
    return rows.select("document_id", "from", (F.col("__no") - 1).alias("no"), "c.chunk_id", "c.type", "c.title", "c.content", meta.alias("metadata"), relations.alias("relationships"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of both_levels with chunk_ord: level-2 chunks count on after the document's level-1 chunks."""
    return rows.withColumn("chunk_ord", F.row_number().over(W.partitionBy("document_id").orderBy(F.col("no") >= 0, "from", "no")) - 1)


def document_id(path: Column | str) -> Column:
    """CHK15: the same for the same path, so a second run replaces the first."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(X.col(path).cast("binary"), 256), 1, 8))


def process(docs: DataFrame, schema: Schema, strict: bool = True, tokenizer=None) -> DataFrame:
    """All chunks of documents (document_id, text), with their relationships."""
    from lathe.operators.edges import with_relationships
    from lathe.sources.scratch import staged

    one = staged(level_one(docs, schema, strict, tokenizer), "level-one")
    return with_relationships(staged(one.unionByName(level_two(one, schema, tokenizer)), "chunks"), schema)


def document_metadata(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """CHK16: requests (document_id, document_name, document_type and more) with the name that was asked for, else the source's title, else "Untitled"; sources: document_id, title, source_file."""
    both = requests.join(sources.select("document_id", "title", "source_file"), "document_id", "left")
    name = F.coalesce(X.empty_to_null(F.col("document_name")), X.empty_to_null(F.col("title")), F.lit("Untitled"))
    return both.withColumn("document_name", name).withColumn("source_file", F.coalesce("source_file", F.lit(""))).drop("title")
