"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A text is cut into lines, at line feeds and after sentence ends, so that a
passage pasted inside a line is seen too.  The steps are:

1. Select.  A window is a minimal run: the lines from a start until min_chars
   characters are reached.  Of each window the least line is selected as
   fingerprint (longest first, then by hash, so that common short lines are
   seldom taken).  Two places that share min_chars characters in whole lines
   share a window, hence its fingerprint.
2. Join.  Fingerprints that occur once are gone; every start whose window has a
   repeated one is a candidate, whatever document holds it.
3. Extend.  At candidate starts whole runs are hashed: the window, and, where the
   next start's window ends more than one line further on, the same run longer by
   each line between.  A line is in a repeated run of min_chars or more exactly if
   it is in a repeated one of these, so that the first holder of a run is the only
   partner to compare with: no run depends on which document is tried.
4. Delete.  Where a run has an earlier place, the lines of the later one go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, stage

MIN_CHARS = 150
#: Zero-width, so that the lines together are the text.
CUT = r"(?<=\n)|(?<=[.!?] )"
#: The same ends as plain strings, and a mark to set behind them; texts that hold the mark go by CUT.
ENDS, MARK = ("\n", ". ", "! ", "? "), "\x01"
#: A key that holds a share of 1 / HOT of all places or more is hot: at most HOT keys are.
HOT = 1024


def lines_of(text: Column) -> Column:
    marked = reduce(lambda x, e: F.replace(x, F.lit(e), F.lit(e + MARK)), ENDS, text)
    return F.when(F.contains(text, F.lit(MARK)), F.split(text, CUT)).otherwise(F.split(marked, MARK))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS))


def _sums(sizes: Column) -> Column:
    """Of each line on, the characters of 4 and of 16 lines; null where there are fewer."""
    add = lambda c, step: F.transform(c, lambda x, i: x + F.get(c, i + step) + F.get(c, i + 2 * step) + F.get(c, i + 3 * step))
    return let(add(sizes, 1), lambda four: F.struct(sizes.alias("one"), four.alias("four"), add(four, 4).alias("sixteen")))


def _reach(sums: Column, i: Column, min_chars: int) -> Column:
    """How many lines from i on have min_chars together; null where the text ends before. A line has a character at least.

    Up to eight lines do for most starts; else steps of 16, 4 and 1 lines are made while the characters stay below min_chars.
    The state is characters << 12 | lines.
    """
    one = sums["one"]

    def steps(state: Column | None, of: Column, step: int, most: int) -> Column:
        n, chars = (F.lit(0), F.lit(0)) if state is None else (state.bitwiseAND(4095), F.shiftright(state, 12))
        out, now, total = None, F.lit(0) if state is None else state, chars
        for k in range(most):
            total = total + F.get(of, i + n + k * step)
            stop = F.coalesce(total >= min_chars, F.lit(True))
            out = F.when(stop, now) if out is None else out.when(stop, now)
            now = F.shiftleft(total, 12).bitwiseOR(n + (k + 1) * step)
        return now if out is None else out.otherwise(now)

    last = lambda s: F.when(F.get(one, i + s.bitwiseAND(4095)).isNotNull(), s.bitwiseAND(4095) + 1)
    many = let(let(let(steps(None, sums["sixteen"], 16, min_chars // 16), lambda s: steps(s, sums["four"], 4, 3)), lambda s: steps(s, one, 1, 3)), last)
    first, second, third = (F.get(one, i + k) for k in range(3))
    few = F.when(first >= min_chars, F.lit(1)).when(first + second >= min_chars, F.lit(2)).when(first + second + third >= min_chars, F.lit(3)).otherwise(F.lit(4))
    four, (fifth, sixth, seventh) = F.get(sums["four"], i), (F.get(one, i + k) for k in range(4, 7))
    some = F.when(four + fifth >= min_chars, F.lit(5)).when(four + fifth + sixth >= min_chars, F.lit(6)).when(four + fifth + sixth + seventh >= min_chars, F.lit(7)).otherwise(F.lit(8))
    return F.when(four >= min_chars, few).when(four + F.get(sums["four"], i + 4) >= min_chars, some).otherwise(many)


def _least(order: Column, body) -> Column:
    """body(f), where f(n, i) is the least of the n values from i on; the values of 4 and of 16 places are compared once.

    The copy of the array is one of plain objects, of which slices are cheap.
    """

    def over(c: Column, step: int) -> Column:
        return F.transform(c, lambda x, i: F.least(x, *(F.get(c, i + k * step) for k in range(1, 4))))

    def least(m: Column):
        at = lambda name, i: F.get(m[name], i)
        return lambda n, i: (
            F.when(n == 1, at("one", i))
            .when(n == 2, F.least(at("one", i), at("one", i + 1)))
            .when(n == 3, F.least(at("one", i), at("one", i + 1), at("one", i + 2)))
            .when(n <= 8, F.least(at("four", i), at("four", i + n - 4)))
            .when(n < 16, F.least(at("four", i), at("four", i + 4), at("four", i + n - 8), at("four", i + n - 4)))
            .when(n <= 32, F.least(at("sixteen", i), at("sixteen", i + n - 16)))
            .otherwise(F.array_min(F.slice(m["one"], i + 1, n)))
        )

    plain = F.transform(order, lambda x: x)
    levels = let(plain, lambda c: let(over(c, 1), lambda four: F.struct(c.alias("one"), four.alias("four"), over(four, 4).alias("sixteen"))))
    return let(levels, lambda m: body(least(m)))


def _doc(docs: DataFrame, key: str, text: str) -> dict[str, Column]:
    """A document's identity and place in the order: null keys last, then by key and hash of the text."""
    return {"z": F.col(key).isNull(), "d": F.col(key), "t": F.xxhash64(text)}


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["z"] == b["z"]) & a["d"].eqNullSafe(b["d"]) & (a["t"] == b["t"])


def select(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: z, d, t (its place in the order), l (hashes of its lines with content), r (lines of the window
    from each of them that has one) and picks: h, a, b, the fingerprint of the windows from start a up to, not with, b."""
    lines = docs.select(
        *(c.alias(n) for n, c in _doc(docs, key, text).items()),
        F.filter(F.transform(lines_of(F.lower(F.col(text))), _bare), lambda b: b != "").alias("lines"),
    )
    hashed = lines.select("z", "d", "t", F.transform("lines", lambda b: F.xxhash64(b)).alias("l"), F.transform("lines", lambda b: F.length(b)).alias("s"))
    reaches = lambda sums: F.filter(F.transform("s", lambda _, i: _reach(sums, i, min_chars)), lambda n: n.isNotNull())
    rank = lambda s, h: F.shiftleft((F.lit(127) - F.least(s, F.lit(127))).cast("long"), 56).bitwiseOR(h.bitwiseAND(2**56 - 1))
    reach = hashed.select("z", "d", "t", "l", F.zip_with("s", "l", rank).alias("o"), let(_sums(F.col("s")), reaches).alias("r"))

    def picks(p: Column) -> Column:
        # a window's fingerprint is its leftmost least line: another one, also if it is equal, once the line before the start was it
        new = lambda x, i: (i == 0) | (x != F.get(p, i - 1)) | (F.get("o", i - 1) == F.get(p, i - 1))
        begins = F.filter(F.transform(p, lambda x, i: F.when(new(x, i), i)), lambda i: i.isNotNull())
        return let(begins, lambda b: F.transform(b, lambda i, j: F.struct(F.get(p, i).alias("h"), i.alias("a"), F.coalesce(F.get(b, j + 1), F.size(p)).alias("b"))))

    # the windows that reach min_chars are those of the first starts; no filter here, as it would be pushed into the lambdas
    return reach.select("z", "d", "t", "l", "r", let(_least(F.col("o"), lambda least: F.transform("r", least)), picks).alias("picks"))


def _join(places: DataFrame, found: DataFrame, total: int, on: list[str]) -> DataFrame:
    """places with the columns that found (one row per key, n places each) has for their key; others go.

    Places of hot keys meet them by broadcast, since at most HOT keys can hold 1 / HOT of the places each; the others by shuffle.
    """
    is_hot = F.col("n") * HOT >= total
    hot = F.broadcast(found.where(is_hot).drop("n"))
    cold = places.join(hot.select(*on), on, "left_anti").join(found.where(~is_hot).drop("n"), on)
    return places.join(hot, on).unionByName(cold)


def candidates(selected: DataFrame) -> DataFrame:
    """The documents with a repeated fingerprint: z, d, t, l, r and starts, those of the windows that have one."""
    places = selected.select("z", "d", "t", F.inline("picks"))
    twice = stage(places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "winnow-twice")
    total = selected.agg(F.sum(F.size("picks"))).first()[0] or 0
    some = _join(places, twice, total, ["h"])
    of = some.groupBy("z", "d", "t").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    rows = selected.select("z", "d", "t", "l", "r").dropDuplicates(["z", "d", "t"])
    starts = F.flatten(F.transform("ranges", lambda x: F.sequence(x.a, x.b - 1)))
    return rows.join(of, _same(rows, of)).select(rows["z"], rows["d"], rows["t"], "l", "r", starts.alias("starts"))


def runs_of(candidates: DataFrame) -> DataFrame:
    """z, d, t and h, m (two hashes and the number of lines), i (the first line, of those with content) of each run."""

    def printed(l: Column, i: Column, n: Column) -> Column:
        check = lambda s: F.struct(F.xxhash64(s).alias("h"), F.shiftleft(n.cast("long"), 32).bitwiseOR(F.hash(s).cast("long").bitwiseAND(2**32 - 1)).alias("m"), i.alias("i"))
        return let(F.slice(l, i + 1, n), check)

    def from_(l: Column, i: Column) -> Column:
        """The window from i, and the longer runs up to where the next start's window ends; behind the last start up to the end."""
        n = F.get("r", i)
        upto = F.coalesce(F.get("r", i + 1), F.size("l") - i)
        return F.transform(F.sequence(n, F.greatest(n, upto)), lambda k: printed(l, i, k))

    # of an array of plain objects slices are cheap; of one in a row's bytes each would copy the whole
    runs = let(F.transform("l", lambda h: h), lambda l: F.flatten(F.transform("starts", lambda i: from_(l, i))))
    return candidates.select("z", "d", "t", F.inline(runs))


def repeated_runs(selected: DataFrame) -> DataFrame:
    """z, d, t and runs: the (a, b) first and last lines, of those with content, of repeated runs that have an earlier place.

    Runs of one document neither overlap nor touch.
    """
    places = stage(runs_of(candidates(selected)), "winnow-runs")
    place = F.struct("z", "d", "t", "i")
    first = stage(places.groupBy("h", "m").agg(F.min(place).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1"), "winnow-first")
    later = _join(places, first, places.count(), ["h", "m"]).where(~place.eqNullSafe(F.col("o")))
    last = F.col("i") + F.shiftright("m", 32).cast("int") - 1
    each = later.groupBy("z", "d", "t").agg(F.sort_array(F.collect_set(F.struct(F.col("i").alias("a"), last.alias("b")))).alias("s"))

    def joined(s: Column) -> Column:
        """Starts and ends never fall in this order, so a run begins where the one before has ended."""
        begins = F.filter(s, lambda x, j: (j == 0) | F.coalesce(x.a > F.get(s, j - 1).b + 1, F.lit(False)))
        ends = F.filter(s, lambda x, j: (j == F.size(s) - 1) | F.coalesce(F.get(s, j + 1).a > x.b + 1, F.lit(False)))
        return F.zip_with(begins, ends, lambda x, y: F.struct(x.a.alias("a"), y.b.alias("b")))

    return each.select("z", "d", "t", let(F.col("s"), joined).alias("runs"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with its text cut, and removed_lines, removed_chars (long).

    The first place of a run, in the order of (key, hash of the text, line), stays;
    every later one goes.  Null and empty texts stay as they are.  Keys are of
    any type that can be ordered; rows with a null key come last in the order.
    Repeated rows are one document: each is cut as the first is.  Other columns
    stay as they are, but for own ones named removed_lines or removed_chars,
    which are replaced.
    """
    selected = stage(select(docs, key, text, min_chars), "winnow")
    found = repeated_runs(selected)
    runs = found.select(*(F.col(c).alias(f"_gl_{c}") for c in ("z", "d", "t")), F.col("runs").alias("_gl_runs"))
    keyed = docs.withColumns({f"_gl_{n}2": c for n, c in _doc(docs, key, text).items()})
    same = (F.col("_gl_z") == F.col("_gl_z2")) & F.col("_gl_d").eqNullSafe(F.col("_gl_d2")) & (F.col("_gl_t") == F.col("_gl_t2"))
    joined = keyed.join(runs.hint("shuffle_hash"), same, "left")

    def left(l: Column) -> Column:
        """The lines before, between and behind the runs."""
        content = F.filter(F.transform(l, lambda x, i: F.when(_bare(x) != "", i)), lambda i: i.isNotNull())
        gone = let(content, lambda c: F.transform("_gl_runs", lambda r: F.struct(F.get(c, r.a).alias("a"), F.get(c, r.b).alias("b"))))
        after = lambda g, r, j: F.slice(l, r.b + 2, F.coalesce(F.get(g, j + 1).a, F.size(l)) - r.b - 1)
        return let(gone, lambda g: F.concat(F.slice(l, F.lit(1), g[0].a), F.flatten(F.transform(g, lambda r, j: after(g, r, j)))))

    result = lambda l, k: F.struct(F.array_join(k, "").alias("text"), (F.size(l) - F.size(k)).cast("long").alias("n"))
    cut = F.when(F.col("_gl_runs").isNotNull(), let(lines_of(F.col(text)), lambda l: let(left(l), lambda k: result(l, k))))
    done = joined.withColumn("_gl_cut", cut)
    new = F.when(F.col("_gl_cut").isNotNull(), F.col("_gl_cut.text")).otherwise(F.col(text))
    chars = F.when(F.col("_gl_cut").isNotNull(), F.length(text) - F.length("_gl_cut.text")).otherwise(F.lit(0))
    out = done.withColumns({"removed_lines": F.coalesce("_gl_cut.n", F.lit(0).cast("long")), "removed_chars": chars.cast("long"), text: new})
    return out.drop(*(f"_gl_{c}{k}" for c in ("z", "d", "t") for k in ("", "2")), "_gl_runs", "_gl_cut")
