"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

A line's set: every window of SHINGLE characters; a shorter line is one. Two lines are alike when the Jaccard
similarity of their sets is SIMILARITY percent or more. Signatures take a part of the windows, chosen by the
characters themselves, so that an inserted or lost character moves none but those around it: those that begin at a
word, at characters of scripts without spaces, and, in words longer than a shingle, at vowels, digits and
capitals. A signature: the smallest hash in each of BINS ranges of the hash space (one-permutation
MinHash); an empty range borrows the next one's. A band is the value of a kept range with that of the next.

Lines that share a band with others get their whole set, and a parity sketch of it, which bounds the symmetric
difference of two sets from below, so pairs that cannot be alike never leave a join. First lines
meet the most connected line of each of their bands; then the nearest of a sample of each band, in rounds
while these link much; then, across the components that this gives, the lines outside a band's largest
component meet all of the band. Every pair that passes is verified by exact Jaccard similarity of the whole
sets, and one line of each component stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, beside, bind, durable, packed, scratch, table
from .components import components

SHINGLE, SIMILARITY = 12, 80
#: Hash ranges (as a power of 2), and which of each eight give a band; small sets use all.
BIN_BITS, KEPT_BINS, SMALL = 4, (0, 3, 5), 12
#: Longs of a parity sketch (a power of 2, 16 at most); lines of a band of which another line takes the nearest.
SKETCH, HUBS = 16, 32
_WORD_BITS = SKETCH.bit_length() - 1
#: Rounds of nearest lines go on while one in so many of the lines that took part is linked anew.
WORTH = 8

#: Characters of long words, and of scripts without spaces, at which a shingle begins.
_BEGINS = "aeiou0-9A-Z\\x{0E00}-\\x{10FFFF}"
#: Characters below U+0E00 but those of \s. As ranges, the most frequent one first, they cost the matcher a third of `[^\s...]`.
_IN_WORDS = "[!-\\x{0DFF}\\x00-\\x08\\x0E-\\x1F]"
#: A whole word that fits in a shingle, or a piece of a longer run up to the next place where one begins.
#: Nothing here is given back after it has matched, so every repeat is possessive.
_PIECES = f"(?s)(?=(.{{1,{SHINGLE}}}+))(?:{_IN_WORDS}{{1,{SHINGLE}}}+(?!\\S)|\\S[^\\s{_BEGINS}]{{0,{SHINGLE - 1}}}+)\\s*+"


def shingles(line: Column) -> Column:
    """Sorted hashes of the windows of a line that its signature takes, repeats included."""
    pieces = F.regexp_extract_all(line, F.lit(_PIECES), F.lit(1))
    return F.sort_array(F.transform(pieces, lambda p: F.xxhash64(p)))


def windows(line: Column) -> Column:
    """Hashes (odd numbers) of all windows of SHINGLE characters, repeats included; a shorter line is one window."""
    every = F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))."), F.lit(1))
    return F.transform(F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(every), lambda w: F.xxhash64(w).bitwiseOR(1))


def bands(hashes: Column) -> Column:
    """Band keys of a sorted array of shingle hashes."""

    def bin_of(h: Column) -> Column:
        return F.shiftright(h, 64 - BIN_BITS)

    def of_firsts(small: Column):
        def keys(firsts: Column) -> Column:
            n = F.size(firsts)
            kept = F.transform(
                firsts,
                lambda h, i: F.when(
                    small | F.pmod(bin_of(h), F.lit(8)).isin(*KEPT_BINS), F.xxhash64(h, firsts.getItem((i + 1) % n))
                ),
            )
            return F.array_compact(kept)

        return keys

    def of_sorted(s: Column) -> Column:
        firsts = F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(s.getItem(F.greatest(i - 1, F.lit(0))))))
        return bind(firsts, of_firsts(F.size(s) <= SMALL))

    return bind(hashes, of_sorted)


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_doc (identity of a document's key and text), key, pos, line and _line (identity) of lines with a word."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = docs.select(F.col(f"`{key}`").alias("_key"), body.alias("_text"), _identity(key, text).alias("_doc"))
    lines = own.select("_key", "_doc", F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
    return lines.where(F.col("line").rlike(WORD)).withColumn("_line", F.unhex(F.md5(F.col("line").cast("binary"))))


def _identity(key: str, text: str) -> Column:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return F.unhex(F.md5(F.concat_ws("\0", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), body).cast("binary")))


def _sketches(lines: DataFrame) -> DataFrame:
    """_line, n (size of its set) and s0 ...: parities of the numbers of hashes in each of 64 classes of SKETCH ranges."""
    each = lines.select("_line", F.explode(F.array_distinct(windows(F.col("line")))).alias("h"))
    word, bit = F.shiftright("h", 64 - _WORD_BITS) + SKETCH // 2, F.expr("shiftleft(1L, cast(shiftright(h, 1) & 63 as int))")
    each = each.select("_line", word.alias("w"), bit.alias("b"))
    words = [F.bit_xor(F.when(F.col("w") == k, F.col("b")).otherwise(F.lit(0).cast("long"))).alias(f"s{k}") for k in range(SKETCH)]
    return each.groupBy("_line").agg(F.count(F.lit(1)).alias("n"), *words)


def _texts(active: DataFrame, docs_lines: DataFrame) -> DataFrame:
    """_line and line of the lines of active: a text is an eighth of its set, which is made again where it is needed."""
    named = active.select("_line").distinct()
    lines = docs_lines.join(beside(durable(named, "named")), "_line", "left_semi")
    return durable(lines.select("_line", "line").distinct(), "texts")  # one of each _line would be found by a sort of the texts


def _as_other(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({c: f"{c}_2" for c in rows.columns if c != "band"})


def _bounded(sizes: Column, apart: Column) -> Column:
    """Whether sets of that many shingles in all, which differ in `apart`, are near: (sizes - apart) / (sizes + apart) is their similarity."""
    return (100 - SIMILARITY) * sizes >= (100 + SIMILARITY) * apart


def _may_be_near() -> Column:
    """False only for pairs below SIMILARITY: the sets differ in at least as many shingles as the sketches in bits."""
    bits = [F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"s{k}_2"))) for k in range(SKETCH)]
    return _bounded(F.col("n") + F.col("n_2"), sum(bits, F.lit(0)))


def _near(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b; n: the sizes of their sets added up) that are like each other."""
    left, right = texts.select(F.col("_line").alias("a"), F.col("line").alias("_ta")), texts.select(F.col("_line").alias("b"), F.col("line").alias("_tb"))
    # what is in both sets is what the sizes are above the union's
    union = F.size(F.array_union(windows(F.col("_ta")), windows(F.col("_tb"))))
    return durable(pairs.join(left, "a").join(right, "b").where(100 * F.col("n") >= (100 + SIMILARITY) * union).select("a", "b"), "linked")


def _shared(rows: DataFrame) -> DataFrame:
    """The bands of several lines."""
    who = F.xxhash64("_line")  # a number: smallest and largest of binary values would sort all rows
    return rows.groupBy("band").agg(F.min(who).alias("_a"), F.max(who).alias("_b")).where("_a <> _b").select("band")


def line_components(lines: DataFrame, docs_lines: DataFrame) -> DataFrame:
    """node and component of every line that is like another one, with a similarity of SIMILARITY or more.

    lines: _line and its band keys, repeats allowed. docs_lines: _line and line, read again for
    the lines that are compared.
    """
    rows = lines.select("_line", F.explode("bands").alias("band"))
    active = durable(rows.join(beside(durable(_shared(rows), "bands")), "band").distinct(), "active")
    texts = _texts(active, docs_lines)
    # the line whose bands hold the most lines is the likeliest to be near to the others
    size = active.groupBy("band").agg(F.count(F.lit(1)).alias("_size"))
    degree = active.join(size, "band").groupBy("_line").agg(F.sum("_size").alias("_degree"))
    own = active.join(_sketches(texts).join(degree, "_line"), "_line")
    own = durable(own, "sketched")
    columns = ["band", "_line", "_degree", "n", *[f"s{k}" for k in range(SKETCH)]]
    found, rounds = None, 0
    meet = _central
    while True:
        own = _open(own.select(*columns), found)  # a band that is done stays so
        pairs = meet(own, rounds)
        linked = _near(durable(pairs.select(F.least("_line", "_line_2").alias("a"), F.greatest("_line", "_line_2").alias("b"), (F.col("n") + F.col("n_2")).alias("n")).distinct(), "pairs"), texts)
        n = linked.count()
        if found is None or n:
            found = _merged(found, linked)
        if meet is _across:
            return found
        # after the rounds that give most components, all that may be near and is still apart
        meet = _nearest if meet is _central or n * WORTH > own.where("_outside").select("_line").distinct().count() else _across
        rounds += 1


def _merged(found: DataFrame | None, linked: DataFrame) -> DataFrame:
    """node and component once the pairs (a, b) are linked too; only components that they touch are looked at."""
    if found is None:
        return components(linked)
    a, b = found.select(F.col("node").alias("a"), F.col("component").alias("_ca")), found.select(F.col("node").alias("b"), F.col("component").alias("_cb"))
    between = linked.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_ca", "a").alias("a"), F.coalesce("_cb", "b").alias("b")).distinct()
    moved = components(durable(between, "between")).select(F.col("node").alias("_c"), F.col("component").alias("_to"))
    known = found.join(moved, F.col("component") == F.col("_c"), "left").select("node", F.coalesce("_to", "component").alias("component"))
    fresh = moved.join(found, F.col("_c") == F.col("node"), "left_anti").select(F.col("_c").alias("node"), F.col("_to").alias("component"))
    return durable(known.union(fresh), "components")


def _open(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """rows with component, of the bands that hold several; _outside: not in the largest of the band's."""
    if found is None:
        return rows.withColumns({"component": F.col("_line"), "_outside": F.lit(True)})

    def labelled(own: DataFrame) -> DataFrame:
        known = found.withColumnRenamed("node", "_line")
        return own.join(known, "_line", "left").withColumn("component", F.coalesce("component", "_line"))

    # sketches are read once, with the bands that stay open
    counts = labelled(rows.select("band", "_line")).groupBy("band", "component").agg(F.count(F.lit(1)).alias("_n"))
    opened = counts.groupBy("band").agg(F.max(F.struct("_n", "component")).alias("_main"), F.count(F.lit(1)).alias("_of")).where("_of > 1")
    opened = durable(opened.select("band", F.col("_main.component").alias("_main")), "bands")
    active = labelled(rows.join(beside(opened), "band"))
    return durable(active.withColumn("_outside", F.col("component") != F.col("_main")).drop("_main"), "open")


def _hub(rows: DataFrame, *by: str) -> DataFrame:
    """For each of by the row of most connections."""
    columns = ["_degree", "_line", "n", *[f"s{k}" for k in range(SKETCH)], "component"]
    return rows.groupBy(*by).agg(F.max(F.struct(*columns)).alias("_hub"))


def _central(rows: DataFrame, _: int) -> DataFrame:
    """Each line with the most connected line outside the largest component of each of its bands."""
    hubs = _hub(rows.where("_outside"), "band").select("band", "_hub.*")
    return rows.join(_as_other(hubs), "band").where((F.col("component") != F.col("component_2")) & _may_be_near())


def _nearest(rows: DataFrame, round_: int) -> DataFrame:
    """Each line outside the largest component with the nearest, by sketches, of up to HUBS lines of each of its bands.

    The first time these are the most connected ones of as many parts of the band, then any.
    """
    part = F.pmod(F.xxhash64("_line", F.lit(round_)), F.lit(HUBS))
    drawn = rows if round_ == 1 else rows.withColumn("_degree", F.xxhash64("_line", F.lit(-round_)))
    hubs = _hub(drawn.withColumn("_part", part), "band", "_part").groupBy("band").agg(F.collect_list("_hub").alias("_hubs"))

    def apart(h: Column) -> Column:
        return sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(h[f"s{k}"])) for k in range(SKETCH)), F.lit(0))

    near = F.filter("_hubs", lambda h: (h["component"] != F.col("component")) & _bounded(F.col("n") + h["n"], apart(h)))
    best = F.array_min(F.transform(near, lambda h: F.struct(apart(h).alias("d"), h["_line"].alias("_line"), h["n"].alias("n"))))
    met = rows.where("_outside").join(hubs, "band").select("_line", "n", best.alias("_best"))
    return met.where("_best is not null").select("_line", "n", F.col("_best._line").alias("_line_2"), F.col("_best.n").alias("n_2"))


def _across(rows: DataFrame, _: int) -> DataFrame:
    """All lines of a band that are in two components and may be near."""
    met = rows.where("_outside").join(_as_other(rows), "band")
    return met.where((F.col("component") != F.col("component_2")) & _may_be_near())


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with, of all lines equal or alike, only the first left; n_lines and n_dropped are added.

    First means smallest key (null first), then position. Lines without a word stay where they
    are and are not counted. A null text stays null. Rows with equal key and text are one
    document and keep the same lines. A document may become empty. Columns with the names of the
    added ones are replaced, all others pass through.
    """
    with scratch() as keep:
        all_lines = _lines(docs, key, text)
        at = durable(all_lines.select("_key", "_doc", "pos", "_line", bands(shingles(F.col("line"))).alias("bands")), "lines")
        found = line_components(at, all_lines.select("_line", "line"))
        classes = durable(found.where("node <> component"), "classes")
        own = at.select("_key", "_doc", "pos", "_line").join(beside(classes), at["_line"] == classes["node"], "left")
        own = own.select(F.coalesce("component", "_line").alias("_class"), F.struct("_key", "_doc", "pos").alias("_at"))
        first = own.groupBy("_class").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last")).where("not (_first <=> _last)")
        first = durable(first.select("_class", "_first"), "firsts")
        dropped = own.join(beside(first), "_class").where("not (_at <=> _first)").select("_at.*")
        dropped = keep(durable(dropped.groupBy("_doc").agg(F.collect_set("pos").alias("_drop")), "dropped"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = packed(docs, ["n_lines", "n_dropped", text], _text=F.col(f"`{text}`"), _doc=_identity(key, text))
    joined = own.join(beside(dropped, 64 + F.size("_drop") * 8), "_doc", "left")
    lines = F.split("_text", "\n")
    kept = bind(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_drop")), lambda i: x.getItem(i)), "\n"))
    counted = F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(WORD))), F.lit(0)).cast("long")
    made = joined.select("_rest", F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(kept).alias("_out"), counted.alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))
    return made.select(*[F.col("_out").alias(c) if c == text else F.col("_rest")[c].alias(c) for c in columns], "n_lines", "n_dropped")


def op2_line_dedup_minhash(spark, sf_dir: str) -> DataFrame:
    deduped = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return deduped.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("text_sha256"))
