"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

Paragraphs are lines. A paragraph is cut into pieces after words whose hash says so, about every
PIECE words; consecutive paragraphs form a section that ends with a paragraph whose hash says so.
Both kinds of border depend only on what stands there, so an edit changes the branch it is in and
no other. A leaf is the SHA-256 of a piece, an inner node the SHA-256 of its children, the root
also covers the length of the text.

A fingerprint is a string: the root (64 hexadecimal digits), a colon and the tree, sections
separated by `;`, each as `hash=` and its paragraphs separated by spaces, each as `hash/` and its
leaves separated by commas. Inner hashes and leaves are cut to SHORT digits there; a leaf is
followed by the number of characters it stands for. Equal roots mean equal texts; unequal ones
are compared branch by branch."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Mean words of a piece; digits of the hashes inside the tree.
PIECE, SHORT = 16, 10
#: Documents are put in order by ranges of ids of about this many rows, at most so many ranges.
ROWS_OF_RANGE, MOST_RANGES = 500, 20_000
MARK = "\x01"


def pieces(paragraph: Column) -> Column:
    """Array of the pieces of a paragraph. Joined they give the paragraph again, with a mark
    after the words that end a piece and marks of the text itself doubled."""
    words = F.split(F.replace(paragraph, F.lit(MARK), F.lit(MARK * 2)), " ", -1)
    marked = F.transform(words, lambda w: F.when(F.pmod(F.xxhash64(w), F.lit(PIECE)) == 0, F.concat(w, F.lit(MARK))).otherwise(w))
    return F.split(F.array_join(marked, " "), f"(?<={MARK})(?= )", -1)


def leaf_hashes(paragraph: Column) -> Column:
    """Hash and length of each piece, as `hash-length`."""
    return F.transform(pieces(paragraph), lambda p: F.concat(F.sha2(p, 256), F.lit("-"), F.char_length(p).cast("string")))


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text column; null counts as empty, which has one empty paragraph."""
    text = F.coalesce(text, F.lit(""))

    def paragraph(p: Column) -> Column:
        """full hash / short leaves, followed by what ends it: a line break at a section's end."""
        def close(leaves: Column) -> Column:
            full = F.sha2(leaves, 256)
            shown = F.regexp_replace(leaves, f"([0-9a-f]{{{SHORT}}})[0-9a-f]{{{64 - SHORT}}}-", "$1")
            return F.concat(full, F.lit("/"), shown, F.when(full < "4", F.lit("\n")).otherwise(F.lit(" ")))
        return F.transform(F.array(F.array_join(leaf_hashes(p), ",")), close)[0]

    paragraphs = F.transform(F.split(text, "\n", -1), paragraph)
    sections = F.split(F.regexp_replace(F.array_join(paragraphs, ""), "[ \n]$", ""), "\n", -1)
    # a section: the hash of its paragraphs' hashes, then those cut short with their leaves
    named = F.transform(sections, lambda s: F.concat(
        F.sha2(F.regexp_replace(s, "/[^ ]*", ""), 256), F.lit("="), F.regexp_replace(s, f"([0-9a-f]{{{SHORT}}})[0-9a-f]{{{64 - SHORT}}}/", "$1/")))

    def rooted(tree: Column) -> Column:
        hashes = F.array_join(F.transform(tree, lambda s: F.substring(s, 1, 64)), ",")
        root = F.sha2(F.concat(F.char_length(text).cast("string"), F.lit(":"), hashes), 256)
        short = F.transform(tree, lambda s: F.concat(F.substring(s, 1, SHORT), s.substr(F.lit(65), F.char_length(s))))
        return F.concat(root, F.lit(":"), F.array_join(short, ";"))
    return F.transform(F.array(named), rooted)[0]


def leaves(print_: Column) -> Column:
    """Leaves of a fingerprint in order, each hash and length."""
    return F.split(F.regexp_replace(F.substring(print_, 66, 2 ** 31 - 1), "[0-9a-f]+[=/]", ""), "[,; ]", -1)


def _length(leaf: Column) -> Column:
    return leaf.substr(F.lit(SHORT + 1), F.char_length(leaf)).cast("int")


def _weight(leafs: Column) -> Column:
    """Characters of distinct leaves, and one for each."""
    return F.aggregate(leafs, F.lit(0).cast("long"), lambda total, x: total + _length(x) + 1)


def likeness(a: Column, b: Column) -> Column:
    """Share of two texts that lies in leaves both have, from their fingerprints alone: characters
    of common distinct leaves over those of all. 1 for equal fingerprints, 0 without a common leaf."""
    def weighed(pair: Column) -> Column:
        common, one, two = _weight(F.array_intersect(pair["a"], pair["b"])), _weight(pair["a"]), _weight(pair["b"])
        return common / (one + two - common)
    pair = F.struct(F.array_distinct(leaves(a)).alias("a"), F.array_distinct(leaves(b)).alias("b"))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).otherwise(F.transform(F.array(pair), weighed)[0])


def differing(a: Column, b: Column) -> Column:
    """Where the text of `a` differs from that of `b`: array of (start, length) of the leaves that
    are in no branch of `b`, in characters of the marked text (one more for each piece border).
    Sections and paragraphs that `b` has too are passed over whole."""
    sections = lambda p: F.split(F.substring(p, 66, 2 ** 31 - 1), ";", -1)
    changed = F.array_except(sections(b), sections(a))
    there = F.flatten(F.transform(changed, lambda s: F.split(F.regexp_replace(s, "[0-9a-f]+[=/]", ""), "[, ]", -1)))
    same = F.array_intersect(sections(a), sections(b))
    # every leaf of `a` with a flag: its section is in `b` too
    own = F.flatten(F.transform(sections(a), lambda s: F.transform(
        F.split(F.regexp_replace(s, "[0-9a-f]+[=/]", ""), "[, ]", -1), lambda x: F.struct(x.alias("leaf"), F.array_contains(same, s).alias("same")))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        size = _length(x["leaf"])
        new = F.array(F.struct(s["at"].alias("start"), size.alias("length")))
        out = F.when(x["same"] | F.array_contains(there, x["leaf"]), s["out"]).otherwise(F.concat(s["out"], new))
        return F.struct((s["at"] + size).alias("at"), out.alias("out"))
    return F.aggregate(own, start, step, lambda s: s["out"])


def next_in_order(docs: DataFrame, id_col: str, carried: list[str], text_col: str) -> DataFrame:
    """`docs` with `next_<c>` for each carried column: its value in the following row by descending
    id, after the last row in the first. Null ids come last; rows of equal id are ordered by
    descending text.

    Ids are cut into ranges by approximate quantiles (at most MOST_RANGES + 1 numbers on the
    driver). Every range also gets, as a guest, the first row of the range that follows, so one
    shuffle by range and a window inside each range see every neighbour."""
    key = F.col(id_col)
    n = docs.count()
    wanted = max(1, min(MOST_RANGES, math.ceil(n / ROWS_OF_RANGE)))
    cuts = docs.agg(F.percentile_approx(key, [i / wanted for i in range(1, wanted)], 10 * wanted)).first()[0] if wanted > 1 else None
    splits = [-math.inf, *sorted({float(c) for c in cuts or [0]}), math.inf]
    ranged = Bucketizer(splits=splits, inputCol="__id", outputCol="__bucket", handleInvalid="keep").transform(
        docs.withColumn("__id", key.cast("double"))).withColumn(
        "__range", F.when(key.isNull(), -1).otherwise(F.col("__bucket").cast("int"))).drop("__id", "__bucket")
    heads = ranged.groupBy("__range").agg(F.max(key).alias("head")).orderBy(F.desc("__range")).collect()
    follow = [(heads[i]["__range"], heads[(i + 1) % len(heads)]["head"]) for i in range(len(heads))]
    follow = docs.sparkSession.createDataFrame(follow, "__of int, __head long")
    first = docs.join(F.broadcast(follow), key.eqNullSafe(F.col("__head"))).groupBy("__of").agg(
        F.first(key).alias(id_col), F.max(text_col).alias(text_col))
    guests = first.select(id_col, text_col, F.col("__of").alias("__range"), F.lit(1).alias("__guest"))
    rows = ranged.select(id_col, text_col, "__range", F.lit(0).alias("__guest")).unionAll(guests)
    rows = rows.withColumns({c: e for c, e in (("fingerprint", fingerprint(F.col(text_col))),) if c in carried})
    w = Window.partitionBy("__range").orderBy("__guest", key.desc_nulls_last(), F.col(text_col).desc())
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).filter("__guest = 0").drop("__guest", "__range")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and fingerprint of its whole text. Null counts as empty; repeated
    rows give repeated rows; other columns are not looked at."""
    return docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, whose second half (the last
    floor(n / 2) code points) is replaced by as many first code points of the next document by
    descending id, or all if it has fewer; the last document takes the first.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next (likeness to the fingerprint of the edited text and of the next document). Null texts
    count as empty. Rows of equal id follow each other by descending text. A lone document is its
    own next one; an empty table gives no rows."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = next_in_order(plain, "doc_id", ["text", "fingerprint"], "text")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint",
                       fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
