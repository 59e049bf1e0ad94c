"""Line deduplication by a segment-partition edit join. DataFrame functions only.

Equal lines are one node. A line of MIN_LINE characters or more is cut into edits + 1 even segments;
two lines within that many edits share a segment, at places that the lengths and the segment's number
narrow to a few. Every line is indexed by its segments and probes with those of its substrings that
could be a segment of a line as long or up to `edits` shorter; a comparison of letter counts, which
no edit changes by more than two, goes with the join. At one edit, the lines of a segment that more than CROWD lines
have (as around a counter) don't meet pairwise, but under what lies beside it less one character. Candidates, trimmed of what they share at either
end, are verified by a banded bit-parallel edit distance. Linked lines form classes (components).

A line is kept where its class first occurs, in order of (doc_id, hash of the text, place); all later
lines of the class are removed, within a document too. Lines of white space only are never
duplicates; shorter lines than MIN_LINE match only equal ones. A null text has no line and stays
null; an empty text has one empty line. Rows equal in doc_id and text are copies: only the first in
order of their other columns keeps its lines. Null doc_ids come last. Class ids are hashes of a class's least line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrier.llm.common import checkpoint, content_order
from harrier.llm.components import components, reshuffled

#: Edits that lines of one class may be apart, link by link, and characters a line needs to be compared by edits.
EDITS, MIN_LINE = 1, 20
#: Lines of one segment from which, at one edit, its lines meet by what they have beside it.
CROWD = 32
_LETTERS = "enatrish"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x20\x09-\x0D]")


def _segment(n: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of a line of n characters; the last ones take the remainder."""
    even, rest = F.floor(n / parts).cast("int"), F.pmod(n, F.lit(parts)).cast("int")
    late = F.greatest(F.lit(0), F.lit(i) - (F.lit(parts) - rest))
    return even * i + late, even + F.when(F.lit(i) >= F.lit(parts) - rest, 1).otherwise(0)


def index_keys(line: Column, n: Column, edits: int) -> Column:
    """A key for each segment: its text with the line's length and its number."""
    out = []
    for i in range(edits + 1):
        at, size = _segment(n, i, edits + 1)
        out.append(F.xxhash64(n, F.lit(i), F.substring(line, at + 1, size)))
    return F.array(*out)


def probe_keys(line: Column, n: Column, edits: int) -> Column:
    """A key for each substring that may be a segment of a line of n - d characters, 0 <= d <= edits."""
    out = []
    for d in range(edits + 1):
        for i in range(edits + 1):
            at, size = _segment(n - d, i, edits + 1)
            low, high = max(-i, d - (edits - i)), min(i, d + (edits - i))
            for shift in range(low, high + 1):
                out.append(F.xxhash64(n - d, F.lit(i), F.substring(line, at + 1 + shift, size)))
    return F.array_distinct(F.array(*out))


def letter_counts(line: Column) -> Column:
    """How often each of a few letters occurs, five bits each in one number."""
    n = F.length(line)
    out = F.lit(0).cast("long")
    for k, c in enumerate(_LETTERS):
        out = out + F.shiftleft(F.pmod(n - F.length(F.replace(line, F.lit(c), F.lit(""))), F.lit(32)).cast("long"), 5 * k)
    return out


def letters_apart(a: Column, b: Column) -> Column:
    """The sum of the differences of letter counts; an edit adds two at most."""
    total = F.lit(0).cast("long")
    for k in range(len(_LETTERS)):
        x, y = (F.shiftright(v, 5 * k).bitwiseAND(F.lit(31).cast("long")) for v in (a, b))
        total = total + F.abs(F.pmod(x - y + 16, F.lit(32)) - 16)
    return total


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _shared(a: Column, b: Column, most: Column) -> Column:
    """Length of the common beginning of two texts, `most` at most, by doubling steps downward."""
    steps = F.array(*[F.lit(2**k) for k in range(20, -1, -1)])

    def longer(got: Column, step: Column) -> Column:
        fits = (got + step <= most) & (F.substring(a, got + 1, step) == F.substring(b, got + 1, step))
        return F.when(fits, got + step).otherwise(got)

    return F.aggregate(steps, F.lit(0), longer)


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two texts is `edits` at most, by bit vectors along the band of the diagonal."""
    width = 2 * edits + 3
    mask = (1 << width) - 1
    long = lambda v: F.lit(v).cast("long")

    def banded(x: Column, y: Column) -> Column:
        # x, y: arrays of characters, both ended by the same edits + 1 marks
        rows = F.size(x)

        def step(s: Column, j: Column) -> Column:
            c = F.get(y, j)
            match = long(0)
            for k in range(width):
                p = j - (width - 1 - edits) + k
                match = match + F.when((p >= 0) & (p < rows) & (F.get(x, F.greatest(p, F.lit(0))) == c), long(1 << k)).otherwise(long(0))
            return _let(match, lambda m: _let(m.bitwiseAND(s["vp"]) + s["vp"], lambda t: advance(s, j, m, t)))

        def advance(s: Column, j: Column, m: Column, t: Column) -> Column:
            d0 = t.bitwiseXOR(s["vp"]).bitwiseOR(m).bitwiseOR(s["vn"]).bitwiseAND(long(mask))
            return _let(d0, lambda d: moved(s, j, d))

        def moved(s: Column, j: Column, d: Column) -> Column:
            hp = s["vn"].bitwiseOR(F.bitwise_not(d.bitwiseOR(s["vp"])).bitwiseAND(long(mask)))
            hn = d.bitwiseAND(s["vp"])
            down = j < rows - edits
            bit = F.lit(width - 2) - (j - (rows - edits))
            at = lambda v: F.pmod(F.floor(v / F.pow(F.lit(2.0), bit.cast("double"))), F.lit(2)).cast("int")
            diagonal = F.when(d.bitwiseAND(long(1 << (width - 1))) == 0, 1).otherwise(0)
            score = s["score"] + F.when(down, diagonal).otherwise(at(hp) - at(hn))
            half = F.shiftright(d, 1)
            return F.struct(hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp)).bitwiseAND(long(mask))).alias("vp"), half.bitwiseAND(hp).alias("vn"), score.cast("int").alias("score"))

        start = F.struct(long(((1 << (edits + 1)) - 1) << (width - 1 - edits)).alias("vp"), long(0).alias("vn"), F.lit(edits).cast("int").alias("score"))
        return F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), start, step)["score"] <= edits

    marks = F.array_repeat(F.lit(""), edits + 1)
    chars = lambda t: F.concat(F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "")), marks)

    def trimmed(both: Column) -> Column:
        x, y = both["x"], both["y"]
        tail = _shared(F.reverse(x), F.reverse(y), F.least(F.length(x), F.length(y)))
        return _let(tail, lambda n: banded(chars(F.substring(x, F.lit(1), F.length(x) - n)), chars(F.substring(y, F.lit(1), F.length(y) - n))))

    head = _shared(a, b, F.least(F.length(a), F.length(b)))
    rest = _let(head, lambda n: _let(F.struct(F.substring(a, n + 1, F.length(a)).alias("x"), F.substring(b, n + 1, F.length(b)).alias("y")), trimmed))
    return F.when(F.abs(F.length(a) - F.length(b)) > edits, False).otherwise(rest)


def _occurrences(docs: DataFrame) -> DataFrame:
    rows = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    return rows.where(~_blank(F.col("line"))).withColumn("lh", F.xxhash64("line"))


def _crowded_pairs(lines: DataFrame, crowd: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines (lh, line) one edit apart that share a crowded segment: what lies beside it has the edit.

    Lines of one length that agree in all characters but one meet under what is left without it, and give links to
    the first of them; a longer line without one of its characters meets the shorter line as it is. So no more pairs
    come up than there are lines, apart from equal hashes.
    """
    n = F.length("line")
    ways = []
    for d in (0, 1):
        for i in (0, 1):
            at, size = _segment(n - d, i, 2)
            start = at + (d if i else 0)
            rest = F.substring(F.col("line"), size + 1, n) if i == 0 else F.substring(F.col("line"), F.lit(1), start)
            ways.append(F.struct(F.lit(d).alias("d"), F.xxhash64(n - d, F.lit(i), F.substring(F.col("line"), start + 1, size)).alias("key"), rest.alias("rest")))
    rows = lines.select("lh", F.explode(F.array(*ways)).alias("w")).select("lh", "w.*").join(crowd, F.col("key") == F.col("k"), "left_semi")
    without = F.transform(F.sequence(F.lit(0), F.length("rest") - 1), lambda j: F.struct(j.alias("j"), F.concat(F.substring(F.col("rest"), F.lit(1), j), F.substring(F.col("rest"), j + 2, F.length("rest"))).alias("left")))
    short = rows.select("lh", "d", "key", F.explode(without).alias("x"))
    same = short.where("d = 0").select("lh", F.xxhash64("key", "x.j", "x.left").alias("g"))
    heads = same.groupBy("g").agg(F.min("lh").alias("a"), F.max("lh").alias("z")).where("a < z").select(reshuffled("g").alias("h"), "a")
    stars = same.join(heads, (F.col("g") == F.col("h")) & (F.col("lh") != F.col("a"))).select("a", F.col("lh").alias("b"))
    whole = rows.where("d = 0").select(F.col("lh").alias("a"), F.xxhash64("key", "rest").alias("g"))
    longer = short.where("d = 1").select(F.col("lh").alias("b"), F.xxhash64("key", "x.left").alias("h"))
    return stars.unionByName(whole.join(longer, F.col("g") == F.col("h")).select("a", "b"))


def line_classes(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """Rows (lh, class, n, first_doc, first_dk, first_at): of each line (by hash) that isn't alone in its class, the class, how many lines it has and where it begins."""
    place = F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "dk", "at")
    once = _occurrences(docs).groupBy("lh").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.first("line").alias("line"))
    size = F.length("line")
    long_ = size >= MIN_LINE
    once = once.select("lh", "n", "first", F.when(long_, index_keys(F.col("line"), size, edits)).alias("own"), F.when(long_, probe_keys(F.col("line"), size, edits)).alias("asked"), F.when(long_, letter_counts(F.col("line"))).alias("letters"), size.alias("size"))
    once = checkpoint(once)
    index = once.select(F.explode("own").alias("key"), "lh", "letters", "size")
    probes = once.select(F.explode("asked").alias("key"), "lh", "letters", "size").alias("p")
    # segments of many lines, such as what a line with a counter has around it, are looked into further
    crowd = None
    if edits == 1:
        crowd = checkpoint(index.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > CROWD).select(F.col("key").alias("k")))
        crowd = None if crowd.isEmpty() else crowd
    sparse = index if crowd is None else index.join(crowd, F.col("key") == F.col("k"), "left_anti")
    # of two lines of one length the smaller hash is probed for
    ahead = (F.col("p.size") > F.col("i.size")) | (F.col("p.lh") > F.col("i.lh"))
    near = letters_apart(F.col("p.letters"), F.col("i.letters")) <= 2 * edits
    pairs = checkpoint(sparse.alias("i").join(probes, (F.col("i.key") == F.col("p.key")) & (F.col("i.lh") != F.col("p.lh")) & ahead & near).select(F.col("i.lh").alias("a"), F.col("p.lh").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w")))
    if crowd is not None:
        wanted = wanted.unionByName(probes.join(crowd, F.col("key") == F.col("k"), "left_semi").select(F.col("lh").alias("w")))
    texts = _occurrences(docs).select("lh", "line").join(wanted.distinct(), F.col("lh") == F.col("w"), "left_semi").groupBy("lh").agg(F.first("line").alias("line"))
    texts = checkpoint(texts)
    if crowd is not None:
        pairs = pairs.unionByName(_crowded_pairs(texts, crowd)).distinct()
    pairs = pairs.join(texts.select(F.col("lh").alias("ka"), F.col("line").alias("la")), F.col("a") == F.col("ka")).join(texts.select(reshuffled("lh").alias("kb"), F.col("line").alias("lb")), F.col("b") == F.col("kb"))
    links = pairs.where(within(F.col("la"), F.col("lb"), edits)).select("a", "b")
    found = components(links)
    own = once.select("lh", "n", "first").join(found.select(F.col("node").alias("c_lh"), F.col("component").alias("class")), F.col("lh") == F.col("c_lh"), "left")
    # lines alone in their class and occurring once need no further look
    own = own.where("n > 1 OR class IS NOT NULL").select("lh", "n", "first", F.coalesce("class", "lh").alias("class"))
    whole = own.groupBy("class").agg(F.sum("n").alias("n"), F.min("first").alias("first")).select(reshuffled("class").alias("k"), "n", "first")
    own = own.select("lh", "class").join(whole, F.col("class") == F.col("k"))
    return own.select("lh", "class", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.dk").alias("first_dk"), F.col("first.at").alias("first_at"))


def marked(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The documents with __dropped: the places of the lines to remove, null where there is none; __classes: class ids of the repeated lines by place."""
    classes = checkpoint(line_classes(docs, edits))
    spots = _occurrences(docs).select("dk", "at", "lh").join(classes.withColumnRenamed("lh", "k"), F.col("lh") == F.col("k"))
    first = F.col("dk").eqNullSafe(F.col("first_dk")) & (F.col("at") == F.col("first_at"))
    # rows that are copies of each other meet here once; which of them keeps its lines is settled below
    spots = spots.groupBy("dk", "at").agg(F.first("class").alias("class"), F.max(first).alias("first"))
    per = spots.groupBy("dk").agg(F.sort_array(F.collect_list(F.struct("at", "class", "first"))).alias("spots")).withColumnRenamed("dk", "k")
    rows = docs.withColumn("__dk", F.xxhash64("doc_id", "text"))
    rows = rows.join(per, F.col("__dk") == F.col("k"), "left").withColumn("__copy", F.row_number().over(Window.partitionBy("__dk").orderBy(content_order(docs, "doc_id", "text"))))
    gone = F.filter("spots", lambda s: ~s["first"] | (F.col("__copy") > 1))
    return rows.withColumn("__dropped", F.transform(gone, lambda s: s["at"])).withColumn("__classes", F.transform("spots", lambda s: s["class"])).drop("__dk", "__copy", "k", "spots")


def kept_text(text: Column, dropped: Column) -> Column:
    lines = F.filter(F.transform(lines_of(text), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(dropped, s["i"]))
    return F.when(dropped.isNull() | (F.size(dropped) == 0), text).otherwise(F.array_join(F.transform(lines, lambda s: s["x"]), "\n"))


def op5_lines(docs: DataFrame) -> DataFrame:
    """A row for each document: lines, lines removed, SHA-256 of the text kept (UTF-8), class ids of its repeated lines in order."""
    rows = marked(docs.select("doc_id", "text"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines_of(F.col("text"))))
    return rows.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(kept_text(F.col("text"), F.col("__dropped")).cast("binary"), 256).alias("kept_sha256"), F.coalesce("__classes", F.array().cast("array<long>")).alias("classes"))


def deduplicated(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The documents without their removed lines; those that lost lines and have none but blank ones left go.

    Columns are those of `docs`; where there is n_chars, it follows the text.
    """
    rows = marked(docs, edits).withColumn("__kept", F.explode(F.array(kept_text(F.col("text"), F.col("__dropped")))))
    rows = rows.where((F.coalesce(F.size("__dropped"), F.lit(0)) <= 0) | ~_blank(F.col("__kept")))
    made = {"text": F.col("__kept"), "n_chars": F.when(F.size("__dropped") > 0, F.length("__kept").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[(made[c] if c in made else F.col(f"`{c}`")).alias(c) for c in docs.columns])
