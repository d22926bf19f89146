"""Line deduplication by a segment-partition edit join, in DataFrame operations alone.

Lines are compared in lower case without outer blanks: those of at least
``MIN_WORDS`` words, or with ``every_line`` (as in the pipeline) all that hold
anything but blanks, counted in characters. Equal lines are one class from the start. A line of n characters is cut
into ``EDITS + 1`` segments; of two lines within ``EDITS`` edits one holds a
segment of the other, near the segment's place. Each line therefore enters the
buckets of its own segments and of those substrings that the lengths and places
of shorter lines' segments allow. Lines that share a bucket are verified by a
banded bit-parallel edit distance; linked lines form classes. The first line of
a class (by document id, then line number) stays, the others go.

Defined results: NULL and empty texts have no lines to compare and stay as they
are; lines not compared always stay; a NULL ``doc_id`` sorts last. A document is told
by its ``doc_id`` and the digest of its text, so documents that share an id (or
have none) lose only their own repeats; of several texts under one id the one
with the smallest digest comes first at a place. Rows equal in both are one document.
A line of fewer than ``MIN_WORDS`` words is close to another at one edit for every
``CHARS_PER_EDIT`` characters of the shorter one, at most ``EDITS``: on sf0.1, two
edits join 106 of 150 such lines under ten characters with some other word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import broadcast_if_small, column, free_names, kept, stored, whole_text
from panelworks.llm.linking import connected, shared_buckets

EDITS = 2
MIN_WORDS = 5
CHARS_PER_EDIT = 10
#: lines of a bucket that meet in pairs, and of one block of a larger bucket
PAIRED, BLOCK = 16, 64
#: a word, then blanks and a word again
WORDY = rf"^\S+(\s+\S+){{{MIN_WORDS - 1}}}"


def compared(line: Column) -> Column:
    """The form in which lines are compared."""
    return F.lower(F.trim(line))


def text_digest() -> Column:
    return F.unhex(F.md5(whole_text()))


def lines_of(docs: DataFrame, every_line: bool = False) -> DataFrame:
    """(doc_id, of, line_no, line) of the lines long enough to be compared, ``of`` being the digest of the
    whole text; line numbers from 0."""
    every = docs.select("doc_id", text_digest().alias("of"), F.posexplode(F.split(whole_text(), "\n")).alias("line_no", "raw"))
    lines = every.select("doc_id", "of", "line_no", compared(F.col("raw")).alias("line"))
    return lines.where(F.col("line").rlike(r"\S" if every_line else WORDY))


def _segment(length: Column, number: int, edits: int) -> tuple[Column, Column]:
    """First place (from 1) and length of a segment; the last ones are longer by one."""
    parts = edits + 1
    base = F.floor(length / parts).cast("int")
    short = F.lit(parts) - (length % parts)  # how many segments have the base length
    start = base * (number - 1) + F.greatest(F.lit(0), F.lit(number - 1) - short) + 1
    return start.cast("int"), (base + F.when(F.lit(number) > short, 1).otherwise(0)).cast("int")


def _places(edits: int) -> list[tuple[int, int, int]]:
    """(less, number, shift): where segment ``number`` of a line shorter by ``less`` may stand.

    It is looked for at a shift of at most number - 1 from its place counted from the left, and of at most
    edits + 1 - number counted from the right. Unshifted places at equal length are a line's own segments.
    """
    found = []
    for less in range(edits + 1):
        for number in range(1, edits + 2):
            lowest = max(-(number - 1), less - (edits + 1 - number))
            highest = min(number - 1, less + (edits + 1 - number))
            found += [(less, number, shift) for shift in range(lowest, highest + 1)]
    return found


def segment_buckets(line: Column, size: Column, edits: int = EDITS) -> Column:
    """Hashes (some NULL) of the own segments and of the substrings where a shorter line's segments may stand."""
    keys = []
    for less, number, shift in _places(edits):
        length = size - less
        start, span = _segment(length, number, edits)
        inside = (start + shift >= 1) & (start + shift + span - 1 <= size) & (length > edits)
        keys.append(F.when(inside, _bucket(F.lit(edits), length, F.lit(number), F.substring(line, start + shift, span))))
    return F.array(*keys)


def _bucket(edits: Column, length: Column, number: Column, part: Column) -> Column:
    return F.xxhash64(edits, length, number, part)


def bucket_rows(lines: DataFrame, edits: int = EDITS, every_line: bool = False) -> DataFrame:
    """(bucket, key) of ``lines`` (key, line, size, own): ``segment_buckets`` at each number of edits that may hold for a
    pair of the line. The places are rows of a constant, so that one short expression hashes them all."""
    levels = range(1, edits + 1) if every_line else (edits,)
    places = [(e, *p) for e in levels for p in _places(e)]
    names = ("edits", "less", "number", "shift")
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, place)]) for place in places])
    rows = lines.select("key", "line", "size", "own", F.explode(table).alias("p"))
    rows = rows.select("key", "line", "size", "own", *[F.col(f"p.{n}").alias(n) for n in names])
    # pairs of a number below this line's own have a short line in them
    e, size = F.col("edits"), F.col("size")
    rows = rows.where((F.col("own") == e) | (F.col("own") > e) & (size < CHARS_PER_EDIT * (e + 1) + e))
    length, parts = size - F.col("less"), e + 1
    base, number = F.floor(length / parts).cast("int"), F.col("number")
    short = parts - length % parts
    start = base * (number - 1) + F.greatest(F.lit(0), number - 1 - short) + 1 + F.col("shift")
    span = base + F.when(number > short, 1).otherwise(0)
    rows = rows.withColumns({"length": length, "start": start.cast("int"), "span": span.cast("int")})
    rows = rows.where((F.col("length") > e) & (F.col("start") >= 1) & (F.col("start") + F.col("span") - 1 <= size))
    part = F.substring(F.col("line"), F.col("start"), F.col("span"))
    return rows.select(_bucket(e, F.col("length"), number, part).alias("bucket"), "key")


def own_edits(line: Column, size: Column, edits: int = EDITS) -> Column:
    """The edits within which a line is close to others; of two lines the smaller number holds."""
    return F.when(line.rlike(WORDY), edits).otherwise(F.least(F.lit(edits), F.floor(size / CHARS_PER_EDIT).cast("int")))


def may_be_close(a: Column, b: Column, size: Column, edits: int = EDITS) -> Column:
    """A necessary condition that costs a few comparisons: of ``3 * edits`` pieces of one line each edit
    spoils at most one, and every other piece stands in the other line, shifted by at most ``edits``."""
    parts = 3 * edits
    found = F.lit(0)
    for number in range(1, parts + 1):
        start, span = _segment(size, number, parts - 1)
        piece = F.substring(a, start, span)
        here = F.lit(False)
        for shift in sorted(range(-edits, edits + 1), key=abs):
            here = here | (piece == F.substring(b, start + shift, span))
        found = found + F.when(here, 1).otherwise(0)
    return found >= parts - edits


def _alike(a: Column, b: Column, room: Column, end) -> Column:
    """How many characters (at most ``room``) two lines share at one end, by halving; ``end(line, n)`` takes n of them."""
    powers = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    return F.aggregate(
        powers,
        F.lit(0),
        lambda n, more: F.when((n + more <= room) & (end(a, n + more) == end(b, n + more)), n + more).otherwise(n),
    )


def edit_distance(edits: int = EDITS):
    """A function of two lines (each longer than ``edits``): their distance, or more than ``edits``.

    Banded and bit-parallel: bit k of every vector stands for the cell in row column + k - edits, so the
    band moves down the diagonal with the columns. The distance is followed along the lower rim of
    the band and then along the last row. What the lines share at their ends is left out, as it costs no
    edit; ``edits + 1`` characters always remain.
    """
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    long = lambda x: F.lit(x).cast("long")
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def distance(x: Column) -> Column:
        one, two, rows = x["one"], x["two"], x["rows"]
        bits = F.array(*[long(1 << k) for k in range(2 * edits - 1, -1, -1)])

        def step(acc: Column, j: Column) -> Column:
            # past this, the last columns cannot bring the distance back
            lost = acc["far"] > 3 * edits

            def with_char(char: Column) -> Column:
                equal = long(0)
                for k in range(width):
                    same = F.coalesce(F.get(one, j + (k - edits)) == char, F.lit(False))
                    equal = equal.bitwiseOR(F.when(same, long(1 << k)).otherwise(long(0)))
                return let(equal, with_equal)

            def with_equal(eq: Column) -> Column:
                vp, vn = acc["vp"], acc["vn"]
                carried = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(long(full))
                return let(carried, with_zero)

            def with_zero(d0: Column) -> Column:
                vp, vn = acc["vp"], acc["vn"]
                up = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(long(full)))
                return let(F.struct(d0.alias("d0"), up.alias("hp"), d0.bitwiseAND(vp).alias("hn")), with_rows)

            def with_rows(y: Column) -> Column:
                d0, hp, hn = y["d0"], y["hp"], y["hn"]
                down = F.shiftright(d0, 1)
                rim = F.when(d0.bitwiseAND(long(top)) == 0, 1).otherwise(0)
                past = (j - (rows - edits)).cast("int")  # columns since the rim met the last row
                last = F.get(bits, past)
                plus = F.when(hp.bitwiseAND(last) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(last) != 0, 1).otherwise(0)
                return F.struct(
                    hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(long(full))).alias("vp"),
                    down.bitwiseAND(hp).alias("vn"),
                    (acc["far"] + F.when(past < 0, rim).otherwise(plus)).alias("far"),
                )

            return F.when(lost, acc).otherwise(let(F.get(two, j), with_char))

        start = F.struct(long(full ^ ((1 << edits) - 1)).alias("vp"), long(0).alias("vn"), F.lit(edits).alias("far"))
        return F.aggregate(F.sequence(F.lit(0), F.size(two) - 1), start, step)["far"]

    def with_ends(x: Column) -> Column:
        a, b = (F.substring(x[c], x["head"] + 1, F.length(x[c]) - x["head"] - x["tail"]) for c in ("a", "b"))
        # bound once per pair: the optimiser would repeat a plain column's split at every step
        return let(F.struct(F.split(a, "").alias("one"), F.split(b, "").alias("two"), F.length(a).alias("rows")), distance)

    def with_head(x: Column) -> Column:
        tail = _alike(x["a"], x["b"], x["room"] - x["head"], F.right)
        return let(F.struct(x["a"].alias("a"), x["b"].alias("b"), x["head"].alias("head"), tail.alias("tail")), with_ends)

    def with_room(x: Column) -> Column:
        head = _alike(x["a"], x["b"], x["room"], F.left)
        return let(F.struct(x["a"].alias("a"), x["b"].alias("b"), x["room"].alias("room"), head.alias("head")), with_head)

    def of(a: Column, b: Column) -> Column:
        room = F.least(F.length(a), F.length(b)) - (edits + 1)
        return let(F.struct(a.alias("a"), b.alias("b"), room.alias("room")), with_room)

    return of


def within_edits(pairs: DataFrame, a: str, b: str, edits: int = EDITS) -> DataFrame:
    """The rows whose two lines, each longer than ``edits``, differ by at most ``edits`` edits."""
    close = pairs.where(F.abs(F.length(a) - F.length(b)) <= edits)
    close = close.withColumn("_size", F.length(a)).where(may_be_close(F.col(a), F.col(b), F.col("_size"), edits))
    return close.where(edit_distance(edits)(F.col(a), F.col(b)) <= edits).drop("_size")


def linked_lines(pairs: DataFrame, texts: DataFrame, edits: int = EDITS) -> DataFrame:
    """The pairs (a, b) of line keys within the edits that hold for both; ``texts``: (key, line, own)."""
    side = lambda k: texts.select(F.col("key").alias(k), F.col("line").alias(f"line_{k}"), F.col("own").alias(f"own_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    close = within_edits(both, "line_a", "line_b", edits)
    own = F.least("own_a", "own_b")
    close = close.where((own >= edits) | (edit_distance(edits)(F.col("line_a"), F.col("line_b")) <= own))
    return close.select("a", "b")


def linked_in_buckets(placed: DataFrame, texts: DataFrame, edits: int = EDITS, paired: int = PAIRED, block: int = BLOCK) -> DataFrame:
    """The linked pairs (a, b) of different components in every bucket of ``placed`` (bucket, key, component).

    Buckets of at most ``paired`` lines make pairs, fewer than ``paired`` / 2 for each line; pairs of several buckets are
    tested once. Larger buckets are compared block against block.
    """
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), (F.min("component") != F.max("component")).alias("open"))
    opened = stored(placed.join(sizes.where("open").drop("open"), "bucket"))
    small = opened.where(F.col("n") <= paired)
    one = small.select("bucket", F.col("key").alias("a"), F.col("component").alias("component_a"))
    two = small.select("bucket", F.col("key").alias("b"), F.col("component").alias("component_b"))
    pairs = one.join(two, "bucket").where("a > b AND component_a <> component_b").select("a", "b").distinct()
    found = linked_lines(pairs, texts, edits)
    large = opened.where(F.col("n") > paired)
    return found.union(linked_in_blocks(large, texts, edits, block)) if large.limit(1).count() else found


def linked_in_blocks(members: DataFrame, texts: DataFrame, edits: int = EDITS, block: int = BLOCK) -> DataFrame:
    """The linked pairs (a, b) of different components in every bucket of ``members`` (bucket, key, component, n).

    The members of a bucket are dealt to blocks of about ``block`` lines; two blocks meet in one row, which
    emits its linked pairs alone. So a bucket of n lines makes n / block rows of each block, dealt to all tasks,
    and no row per pair.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    # at most one bucket for each place of a segment; a pair is tested in the first bucket that both lines have
    shared = members.groupBy("key").agg(F.collect_set("bucket").alias("buckets"))
    dealt = members.join(texts, "key").join(shared, "key").withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("key", F.lit("block")), blocks).cast("int")})
    held = F.collect_list(F.struct("key", "component", "line", "own", "buckets", F.length("line").alias("size")))
    packed = stored(dealt.groupBy("bucket", "blocks", "block").agg(held.alias("members")))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    first = packed.select("bucket", F.col("block").alias("low"), F.explode(F.filter(every, lambda i: i >= F.col("block"))).alias("high"), F.col("members").alias("ours"))
    second = packed.select("bucket", F.explode(F.filter(every, lambda i: i <= F.col("block"))).alias("low"), F.col("block").alias("high"), F.col("members").alias("theirs"))
    met = first.join(second, ["bucket", "low", "high"])
    distance = edit_distance(edits)

    def linked(x: Column, y: Column) -> Column:
        once = (F.col("low") != F.col("high")) | (x["key"] < y["key"])
        apart = (x["component"] != y["component"]) & (F.abs(x["size"] - y["size"]) <= F.least(x["own"], y["own"]))
        first_met = F.col("bucket") == F.array_min(F.array_intersect(x["buckets"], y["buckets"]))
        near = may_be_close(x["line"], y["line"], x["size"], edits)
        return once & apart & first_met & near & (distance(x["line"], y["line"]) <= F.least(x["own"], y["own"]))

    def pair(x: Column, y: Column) -> Column:
        return F.struct(F.greatest(x["key"], y["key"]).alias("a"), F.least(x["key"], y["key"]).alias("b"))

    found = F.flatten(F.transform("ours", lambda x: F.transform(F.filter("theirs", lambda y: linked(x, y)), lambda y: pair(x, y))))
    return met.select(F.explode(found).alias("pair")).select("pair.a", "pair.b").distinct()


def _classes(docs: DataFrame, edits: int, every_line: bool) -> DataFrame:
    """(doc_id, of, line_no, keep, class_size, stays) of every line of a class of several lines."""
    # read twice rather than stored: only distinct lines are, and only once
    lines = lines_of(docs, every_line)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "of")
    # the line itself is the key: one exchange serves the classes and the texts, and alike lines lie together
    distinct = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    own = own_edits(F.col("line"), F.col("size"), edits) if every_line else F.lit(edits)
    distinct = stored(distinct.withColumns({"key": F.xxhash64("line"), "size": F.length("line")}).withColumn("own", own))
    digest = F.unhex(F.md5("line")).alias("digest")
    texts, distinct = distinct.select("key", "line", "size", "own"), distinct.select(digest, "key", "n", "first")
    members = stored(shared_buckets(bucket_rows(texts, edits, every_line)))
    found = None
    if members.limit(1).count():
        keys = members.select("key").distinct()
        near = stored(texts.join(keys, "key", "left_semi").select("key", "line", "own"))
        found = connected(
            members, lambda pairs: linked_lines(pairs, near, edits), lambda placed: linked_in_buckets(placed, near, edits)
        )
    if found is None:
        placed = distinct.withColumn("component", F.concat(F.lit("d"), F.hex("digest")))
    else:
        placed = distinct.join(found, "key", "left").withColumn(
            "component",
            F.coalesce(F.concat(F.lit("k"), F.col("component").cast("string")), F.concat(F.lit("d"), F.hex("digest"))),
        )
    whole = placed.groupBy("component").agg(F.min("first").alias("keep"), F.sum("n").alias("class_size"))
    several = placed.join(whole.where("class_size > 1"), "component").select("digest", "keep", "class_size")
    several = kept(several)
    own = lines.select("doc_id", "of", "line_no", digest).join(broadcast_if_small(several), "digest")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "of")
    return own.withColumn("stays", first.eqNullSafe(F.col("keep"))).drop("digest")


def line_classes(docs: DataFrame, edits: int = EDITS, every_line: bool = False) -> DataFrame:
    """(doc_id, line_no, class_doc_id, class_line_no, class_size, stays) of every line of a class of several lines."""
    return _classes(docs, edits, every_line).select(
        "doc_id",
        "line_no",
        F.col("keep.doc_id").alias("class_doc_id"),
        F.col("keep.line_no").alias("class_line_no"),
        "class_size",
        "stays",
    )


def without_repeated_lines(docs: DataFrame, edits: int = EDITS, every_line: bool = False) -> DataFrame:
    """All documents, without the lines that repeat an earlier one; documents left with no text go.

    Documents that had no text to begin with stay.
    """
    gone_lines, of_id, of_text = free_names(docs.columns, "_gone", "_doc_id", "_of")
    gone = _classes(docs, edits, every_line).where("NOT stays").groupBy("doc_id", "of").agg(F.collect_set("line_no").alias(gone_lines))
    gone = kept(gone).withColumnsRenamed({"doc_id": of_id, "of": of_text})
    mine = F.col("doc_id").eqNullSafe(F.col(of_id)) & (text_digest() == F.col(of_text))
    joined = docs.join(gone, mine, "left")
    kept_lines = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(gone_lines, i))
    text = F.when(F.col(gone_lines).isNull(), F.col("text")).otherwise(F.array_join(kept_lines, "\n"))
    changed = joined.withColumn("text", text)
    left = F.col(gone_lines).isNull() | (F.length(F.trim("text")) > 0)
    return changed.where(left).select([column(c) for c in docs.columns])

