"""Document fingerprints: Merkle trees over words' runs, paragraphs and sections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, text_or_empty

#: A leaf ends after a word whose hash is 0 modulo this, so that an edit moves no other leaf's borders, and with its paragraph.  A longer run without white
#: space counts as words of so many characters.
LEAF_WORDS, WORD_CHARS = 8, 32
#: A section ends after a paragraph whose hash is 0 modulo this, so that an edit moves no other section's borders.
SECTION_PARAGRAPHS = 8
#: Text in one block of neighbours, about, and rows; more blocks than MAX_BLOCKS (8 MB of broadcast borders) are made larger instead.
BLOCK_BYTES, BLOCK_ROWS, MAX_BLOCKS = 4 << 20, 500, 1_000_000
#: Tasks that blocks are dealt to at most; a task sorts its blocks one after another and spills.
TASKS = 20_000


def let(value: Column, of) -> Column:
    """of(value), with ``value`` computed once and not for each element of an array that ``of`` walks."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def leaves_of(text: Column) -> Column:
    """Paragraphs as arrays of 64-bit leaf hashes: array<array<bigint>>."""
    def ends(words: Column) -> Column:
        last = F.size(words) - 1
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.pmod(F.xxhash64(F.get(words, i)), F.lit(LEAF_WORDS)) == 0))

    def leaves(words: Column) -> Column:
        cut = let(ends(words), lambda e: F.transform(e, lambda x, j: let(F.coalesce(F.get(e, j - 1) + 2, F.lit(1)), lambda a: F.xxhash64(F.slice(words, a, x + 2 - a)))))
        return F.when(F.size(words) > 0, cut).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.split(text, "\n"), lambda p: let(F.regexp_extract_all(p, F.lit(rf"\S{{1,{WORD_CHARS}}}\s*"), F.lit(0)), leaves))


def with_tree(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: struct(root, sections), sections array<struct(h, p)> of paragraphs array<struct(h, l)> of leaves, and how many distinct ``leaves``.

    A paragraph's node is the hash of its leaves, a section's that of its paragraphs' nodes, and the root,
    SHA-256 cut to 128 bits, covers the sections' nodes and the text itself: roots are equal exactly for equal texts.
    """
    df = df.withColumn("__p", F.transform(leaves_of(F.col(text)), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("l"))))
    last = F.size("__p") - 1
    df = df.withColumn("__e", F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.pmod(F.get("__p", i)["h"], F.lit(SECTION_PARAGRAPHS)) == 0)))
    parts = F.transform("__e", lambda e, j: let(F.coalesce(F.get("__e", j - 1) + 2, F.lit(1)), lambda a: F.slice("__p", a, e + 2 - a)))
    df = df.withColumn("__s", F.transform(parts, lambda p: F.struct(F.xxhash64(F.transform(p, lambda x: x["h"])).alias("h"), p.alias("p"))))
    nodes = F.concat_ws(",", F.transform("__s", lambda s: F.hex(s["h"])))
    root = F.substring(F.sha2(F.concat(F.sha2(text, 256), F.sha2(nodes, 256)), 256), 1, 32)
    leaves = F.size(F.array_distinct(F.flatten(F.transform("__p", lambda x: x["l"]))))
    return df.withColumn(out, F.struct(root.alias("root"), F.col("__s").alias("sections"), leaves.alias("leaves"))).drop("__p", "__e", "__s")


def printed(tree: str) -> Column:
    """A tree as text, ``root:section.section...``, a section ``hash(paragraph;...)`` with a paragraph's leaves in hex."""
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    line = lambda p: F.array_join(F.transform(p["l"], digits), "")
    section = lambda s: F.concat(digits(s["h"]), F.lit("("), F.array_join(F.transform(s["p"], line), ";"), F.lit(")"))
    return F.concat(F.col(tree)["root"], F.lit(":"), F.array_join(F.transform(F.col(tree)["sections"], section), "."))


def among(x: Column, hashes: Column) -> Column:
    """Elements of ``x`` (structs with h) whose hash is in an array; it's searched in about the square root of its size."""
    width = F.ceil(F.sqrt(F.size(hashes) + 1)).cast("int")
    shelves = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.filter(hashes, lambda h: F.pmod(h, width) == k))
    return let(F.struct(shelves.alias("s"), width.alias("w")), lambda t: F.filter(x, lambda e: F.array_contains(F.get(t["s"], F.pmod(e["h"], t["w"]).cast("int")), e["h"])))


def with_comparison(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``: struct(likeness, branches) of two trees by their common descent.

    Equal roots: 1.  Sections that both have are pruned; leaves are compared only under the others.  The
    likeness is the share of all distinct leaves of both that aren't found on one side alone; trees without leaves are alike.
    Branches are b's differing ones, array<struct(section, paragraph)>: paragraphs under sections that a lacks, without those
    that a has under a section that b lacks; that is where an edit is.
    """
    of = lambda t: F.transform(F.col(t)["sections"], lambda s: s["h"])
    placed = F.transform(F.col(b)["sections"], lambda s, i: F.struct(s["h"].alias("h"), s["p"].alias("p"), i.alias("i")))
    df = df.withColumn("__da", F.array_except(of(a), of(b))).withColumn("__db", F.array_except(of(b), of(a)))
    paragraphs = lambda s: F.transform(s["p"], lambda p, k: F.struct(p["h"].alias("h"), p["l"].alias("l"), s["i"].alias("section"), k.alias("paragraph")))
    df = df.withColumn("__pa", F.flatten(F.transform(among(F.col(a)["sections"], F.col("__da")), lambda s: s["p"])))
    df = df.withColumn("__pb", F.flatten(F.transform(among(placed, F.col("__db")), paragraphs)))
    hashes, leaves = (lambda p: F.transform(p, lambda x: x["h"])), (lambda p: F.flatten(F.transform(p, lambda x: x["l"])))
    df = df.withColumn("__la", leaves("__pa")).withColumn("__lb", leaves("__pb"))
    apart = F.size(F.array_except("__la", "__lb")) + F.size(F.array_except("__lb", "__la"))
    total = F.col(a)["leaves"] + F.col(b)["leaves"]
    like = F.when((F.col(a)["root"] == F.col(b)["root"]) | (total == 0), F.lit(1.0)).otherwise(1.0 - apart / total)
    branches = F.transform(among(F.col("__pb"), F.array_except(hashes("__pb"), hashes("__pa"))), lambda p: F.struct(p["section"], p["paragraph"]))
    return df.withColumn(out, F.struct(like.alias("likeness"), branches.alias("branches"))).drop("__da", "__db", "__pa", "__pb", "__la", "__lb")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) per row, without a shuffle.  Null counts as empty; repeated rows keep their rows; other columns are ignored."""
    df = with_tree(docs.select(F.col(id_col), text_or_empty(text_col).alias("__text")), "__text", "__t")
    return df.select(id_col, F.char_length("__text").cast("long").alias("n_chars"), printed("__t").alias("fingerprint"))


def neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, next_text): the next row by id, an integer; after the last, the first.

    Ids are cut at quantiles that are ids of the table, first into about the square root of the number of blocks, then each part
    likewise.  So the row that follows a block is known where it lies and is sent to both
    blocks; one exchange of the text brings all neighbours together.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("at"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.min("at").alias("low")).first()
    if not size["n"]:
        return rows.select("id", "text", F.lit("").alias("next_text"))
    blocks = max(1, min(MAX_BLOCKS, max(size["bytes"] // BLOCK_BYTES, size["n"] // BLOCK_ROWS)))
    parts = math.isqrt(blocks - 1) + 1
    each = -(-blocks // parts)
    cuts = lambda n: F.percentile_approx("at", [i / n for i in range(n)], 10 * n).alias("q")
    coarse = F.array(*[F.lit(c).cast("long") for c in sorted({size["low"], *rows.agg(cuts(parts)).first()["q"]})])
    rows = rows.withColumn("part", F.size(F.filter(coarse, lambda c: c <= F.col("at"))))
    fine = rows.groupBy("part").agg(cuts(each), F.min("at").alias("low")).select("part", F.array_sort(F.array_distinct(F.array_append("q", F.col("low")))).alias("cuts"))
    fine = materialise(fine, "cuts")
    sizes = {r["part"]: r["n"] for r in fine.select("part", F.size("cuts").alias("n")).collect()}  # at most a thousand
    total, first = 0, []
    for part in range(max(sizes) + 1):
        first.append(total)
        total += sizes.get(part, 0)
    rows = rows.join(F.broadcast(fine), "part")  # at most MAX_BLOCKS numbers
    rows = rows.withColumn("inside", F.filter("cuts", lambda c: c <= F.col("at")))
    begin = F.get(F.array(*[F.lit(x) for x in first]), F.col("part"))
    rows = rows.withColumn("block", begin + F.size("inside") - 1).withColumn("head", F.element_at("inside", -1) == F.col("at")).drop("cuts", "inside", "part")
    before = F.pmod(F.col("block") - 1, F.lit(total))
    copies = F.when(F.col("head"), F.array(F.struct(F.col("block").alias("b"), F.lit(0).alias("copy")), F.struct(before.alias("b"), F.lit(1).alias("copy")))).otherwise(F.array(F.struct(F.col("block").alias("b"), F.lit(0).alias("copy"))))
    dealt = rows.withColumn("to", F.explode(copies)).select("id", "text", "at", F.col("to.b").alias("b"), F.col("to.copy").alias("copy"))
    in_block = Window.partitionBy("b").orderBy("copy", "at", "text")
    return dealt.repartition(min(total, TASKS), "b").withColumn("next_text", F.lead("text").over(in_block)).where("copy = 0").select("id", "text", "next_text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, differing.

    The edited text has the last quarter replaced by the start of the next document (by id).  ``near_*`` and ``differing``,
    the edited text's branches that the text lacks (section:paragraph, comma-joined), come from comparing trees from their roots down.
    Null texts count as empty; null ids come first; of repeated ids the order is by text; a table of one
    row is its own next; an empty table gives none; other columns are ignored.
    """
    df = neighbours(docs, id_col, text_col).withColumn("n", F.char_length("text")).withColumn("k", F.floor(F.col("n") / 4).cast("int"))
    df = df.withColumn("edited", F.concat(F.expr("substring(text, 1, n - k)"), F.expr("substring(next_text, 1, k)")))
    for text, tree in (("text", "t"), ("edited", "te"), ("next_text", "tn")):
        df = with_tree(df, text, tree)
    df = with_comparison(with_comparison(df, "t", "te", "ce"), "t", "tn", "cn")
    places = F.array_join(F.transform("ce.branches", lambda x: F.concat_ws(":", x["section"].cast("string"), x["paragraph"].cast("string"))), ",")
    return df.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), printed("t").alias("fingerprint"), printed("te").alias("edited_fingerprint"),
        F.col("ce.likeness").alias("near_edited"), F.col("cn.likeness").alias("near_next"), places.alias("differing"),
    )


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
