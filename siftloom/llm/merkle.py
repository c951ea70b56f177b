"""Merkle-tree fingerprints of documents (DataFrame functions only).

A text is a tree of four levels: pieces, paragraphs (lines), sections and the root.  A line
is cut into pieces after the first border character (``BORDERS``) from its ``PIECE``-th
character on, so the cuts follow the text and fall into step again after an edit.  A section
ends after a paragraph whose digest ends in a digit below 4, so an inserted paragraph moves no
other section's border.  A piece's digest is the first half of the SHA-256 of its characters;
every other digest is the SHA-256 of its children's digests in order.  So equal texts have
equal roots, and unequal branches lead to the edit.

Likeness descends from equal branches: pieces below a paragraph that both trees have are
common; below the paragraphs that differ, pieces are compared.  It is twice the common
pieces over the pieces of both, each counted once per paragraph digest.

Defined results: a null text is the empty text; the empty text has one empty paragraph;
two texts without any piece are alike (1); repeated rows and equal ids are ordered by
text; a null id comes first; the only row of a table is its own next document; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.llm.registry import query, table
from siftloom.operators.skew import with_positions

#: Characters of a piece before its border is looked for, and at most.
PIECE, LONGEST = 24, 256
#: Characters that end a piece: the blank and letters and digits whose code is a multiple of 8.
BORDERS = " 08HPXhpx"
#: Documents per bucket of neighbours.
BUCKET = 2000


def paragraphs(text: Column) -> Column:
    """array<struct<digest, pieces>> of the lines of a text, with the digests of their pieces."""
    cut = F.lit(rf"[^\n]{{{PIECE - 1},{LONGEST - 1}}}?[{BORDERS}]|[^\n]{{1,{LONGEST}}}")
    pieces = F.transform(F.split(text, "\n"), lambda line: F.transform(
        F.regexp_extract_all(line, cut, F.lit(0)), lambda piece: F.substring(F.sha2(piece, 256), 1, 32)))
    return F.transform(pieces, lambda p: F.struct(F.sha2(F.array_join(p, " "), 256).alias("digest"), p.alias("pieces")))


def leaves(paragraphs_: Column) -> Column:
    """Every piece under its paragraph: array of the first half of the paragraph's digest and the piece's digest.

    They are strings, since sets of structs are compared pair by pair.
    """
    return F.flatten(F.transform(paragraphs_, lambda p: F.transform(
        p["pieces"], lambda x: F.concat(F.substring(p["digest"], 1, 32), x))))


def sections(paragraphs_: Column) -> Column:
    """Digests of the sections over the paragraphs' digests."""
    joined = F.array_join(paragraphs_["digest"], " ")
    # a digest that ends in 0-3 closes a section
    marked = F.regexp_replace(joined, "([0-9a-f]{63}[0-3]) ", "$1\n")
    return F.transform(F.split(marked, "\n"), lambda s: F.sha2(s, 256))


def root(sections_: Column) -> Column:
    return F.sha2(F.array_join(sections_, " "), 256)


def likeness(a: Column, b: Column) -> Column:
    """Common pieces of two trees, given as leaves: twice their number over that of both."""
    each = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    equal = F.size(F.array_intersect(a, b))
    # what hangs below paragraphs that only one tree has
    pieces = lambda rest: F.transform(rest, lambda x: F.substring(x, 33, 32))
    differing = F.size(F.array_intersect(pieces(F.array_except(a, b)), pieces(F.array_except(b, a))))
    return F.when(each == 0, F.lit(1.0)).otherwise(2 * (equal + differing) / each)


def fingerprint(text: Column) -> Column:
    return root(sections(paragraphs(text)))


def edited_branches(a: Column, b: Column) -> Column:
    """Digests (of sections or of paragraphs) of tree ``a`` that tree ``b`` lacks: where the texts differ."""
    return F.array_except(a, b)


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Columns key, text and ``next_text``, the text of the following row by key (after the last: the first).

    Keys alone are numbered; then buckets of neighbours are gathered, each with a copy of
    the first row of the following bucket, so no task sees more than a bucket.
    """
    # equal keys share a position and are ordered by text
    places = with_positions(docs.select(F.col(key).alias("_key")).distinct(), [F.col("_key")], "_place")
    last = places.agg(F.max("_place").alias("_last"))
    rows = docs.select(key, text).join(places, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    bucket = F.floor((F.col("_place") - 1) / BUCKET)
    opens = (F.col("_place") - 1) % BUCKET == 0
    wraps = F.floor((F.col("_last") - 1) / BUCKET)
    own = F.struct(bucket.alias("bucket"), F.col("_place").alias("at"), F.lit(True).alias("own"))
    lent = F.when(F.col("_place") == 1, F.struct(wraps.alias("bucket"), (F.col("_last") + 1).alias("at"), F.lit(False).alias("own"))).when(
        opens, F.struct((bucket - 1).alias("bucket"), F.col("_place").alias("at"), F.lit(False).alias("own")))
    placed = rows.join(F.broadcast(last)).select(key, text, F.explode(F.array_compact(F.array(own, lent))).alias("_p"))
    order = Window.partitionBy("_bucket").orderBy("_place", text)
    return (
        placed.select(key, text, F.col("_p.bucket").alias("_bucket"), F.col("_p.at").alias("_place"), F.col("_p.own").alias("_own"))
        .withColumn("next_text", F.lead(text).over(order)).where("_own").select(key, text, "next_text"))


@query("op8_merkle_fingerprints")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, "doc_id", "text").withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    for name in ("text", "edited", "next_text"):
        rows = rows.withColumn(f"tree_{name}", paragraphs(F.col(name)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[f"tree_{n}" for n in ("text", "edited", "next_text")])
    rows = rows.withColumns({f"sections_{n}": sections(F.col(f"tree_{n}")) for n in ("text", "edited")})
    rows = rows.withColumns({f"leaves_{n}": leaves(F.col(f"tree_{n}")) for n in ("text", "edited", "next_text")})
    own = F.col("leaves_text")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        root(F.col("sections_text")).alias("fingerprint"), root(F.col("sections_edited")).alias("edited_fingerprint"),
        likeness(own, F.col("leaves_edited")).alias("near_edited"), likeness(own, F.col("leaves_next_text")).alias("near_next"),
        F.size(edited_branches(F.col("sections_edited"), F.col("sections_text"))).alias("n_edited_sections"),
        F.size(edited_branches(F.col("tree_edited")["digest"], F.col("tree_text")["digest"])).alias("n_edited_paragraphs"))
