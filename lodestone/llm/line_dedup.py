"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line's tokens are the distinct words between white space of the line in lower case. Two lines match if
the Jaccard similarity of their tokens is at least THRESHOLD (a ratio of whole numbers, here 4/5). Lines
are in the order of (doc_id, hash of the text, line number), null ids first; a line is removed if any
earlier line matches it, in the same document or another one. Lines without tokens stay.

Texts are cut into words once; the words' hashes are kept for two passes, one that counts them and one that
orders them. Lines with equal tokens form a class, whose first line stands for it; classes alone are joined.
Tokens are in a fixed order, rare ones first: the count of each of BUCKETS hash buckets over all lines ranks
them (an array of constant size, read as a scalar subquery), so every line's order agrees whatever the
collisions. A class is entered under the tokens of its prefix, as many as two matching classes can't both
avoid. Where over LARGE classes share a token, they are entered under pairs of that token and a later one of
their prefix, which is longer by one then: matching classes share a second token there too. Pairs of classes
pass the length and positional filters and the parities' bound, and what is left is verified on whole lines.

Copies of a line aren't paired with each other. In groups that stay large though split, each class is first compared
with two others of such groups, the earliest of those that share its two rarest tokens and of those that share its
tokens of least and greatest hash; ROUNDS rounds more compare each class left with the closest of its groups' hubs,
HUBS early ones. Classes found to match an earlier one are settled, and settled classes needn't be compared with each
other; where no group is large there are none. A token that no other line has is entered nowhere. What is left is compared with its closest earlier candidate first, by parities; only classes that don't match that one meet the rest.

Null and empty texts have one line without tokens, and stay. Of repeated rows the first is treated as any
document; the others lose all lines with tokens. Other columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import staged, table, tidy, unstage, whole

#: Jaccard similarity from which lines match, as a ratio of whole numbers.
THRESHOLD = (4, 5)
_BITS, _LOW = 22, 11
BUCKETS = 1 << _BITS
#: Lines of more tokens have parities of two halves of them; 64 bits tell fewer apart well enough (lines of 96 tokens
#: match if 21 are in one of them alone, and of unrelated lines' bits 32 differ, 21 or fewer in one of 200 pairs).
WIDE = 96
#: A token's number has its bucket's class above so many bits of its hash.
_HASH_BITS = 57
#: The class of buckets that one line's token fell into: no other line has it.
_ALONE = 2
#: Places of candidate lines and keys of large groups are broadcast while they are at most so many, else joined by shuffle.
BROADCAST_ROWS = 200_000
#: Groups of more classes are split or thinned before they are paired; results don't depend on it, nor on ROUNDS and HUBS.
LARGE = 256
PART = 16
ROUNDS = 2
HUBS = 8
PASSES = 2
_ID = ["doc_id", "key"]
_PLACE = [*_ID, "line_no"]


def _spaced(text: Column) -> Column:
    """The text with spaces for all other white space but line ends: splitting at one character takes no pattern."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\x0b\f\r", text)


def tokens(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(_spaced(line)), " "), "")


def _lines(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def hashed(documents: DataFrame) -> DataFrame:
    """One row per line: doc_id, key, line_no and h, the hashes of its tokens."""
    text = F.lower(_spaced(F.coalesce("text", F.lit(""))))
    rows = documents.select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    words = F.transform(F.split("line", " "), lambda w: F.xxhash64(w))  # noqa: PLW0108
    return rows.select(*_PLACE, F.array_except(words, F.array(F.xxhash64(F.lit("")))).alias("h"))


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - _BITS).cast("int")


def rarity(found: DataFrame) -> DataFrame:
    """One row with one array: the class of each bucket, twice the binary logarithm of the number of lines with its tokens."""
    every = found.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("n"))
    counted = found.select(F.explode("h").alias("h")).select(_bucket(F.col("h")).alias("b"), F.lit(1).cast("long").alias("n"))
    level = F.least(F.floor(2 * F.log2(F.sum("n") + 1)), F.lit(63)).cast("tinyint")
    levels = counted.unionByName(every).groupBy("b").agg(level.alias("level"))
    rows = levels.groupBy(F.shiftright("b", _LOW).alias("high")).agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "level"))), lambda x: x["level"]).alias("part"))
    return rows.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("high", "part"))), lambda x: x["part"])).alias("levels"))


def _ordered(h: Column, levels: Column) -> Column:
    """The tokens as numbers, one for each token's hash, rare ones first."""

    def number(h: Column, r: Column) -> Column:
        found = F.shiftleft(F.get(r, F.shiftrightunsigned(h, 64 - _BITS)).cast("long"), _HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << _HASH_BITS) - 1)))
        # None is null; where Spark knows that, it sorts longs as they are.
        return F.coalesce(found, F.lit(0).cast("long"))

    return F.sort_array(F.transform(F.array(levels), lambda r: F.transform(h, lambda x: number(x, r)))[0])


def _least(n: Column) -> Column:
    """The smallest overlap with which a line of n tokens can match any other."""
    a, b = THRESHOLD
    return F.expr(f"(n * {a} + {b - 1}) div {b}").cast("int")


def classes(documents: DataFrame) -> DataFrame:
    """One row per line: doc_id, key, line_no, its class (k1, k2), its number of tokens n, its prefix, parities p and q,
    and ends, what names its tokens of least and greatest hash.

    Bit i of a parity tells whether an odd number of tokens falls on it: as many bits as differ between two
    lines, so many tokens at least are in one of them alone. q is of half the tokens, and only of lines of more than
    WIDE; p less q is the other half's.
    """
    found = staged(hashed(documents), "line-hashes")
    levels = staged(rarity(found), "line-rarity")
    ends = F.xxhash64(F.array_min("h"), F.array_max("h")).alias("ends")
    rows = found.withColumn("levels", levels.scalar()).select(*_PLACE, ends, _ordered(F.col("h"), F.col("levels")).alias("all"))
    rows = rows.select(*_PLACE, "ends", F.xxhash64("all").alias("k1"), F.xxhash64(F.lit(1), "all").alias("k2"), F.size("all").alias("n"), "all", _parity().alias("p"), _odd_parity().alias("q"))
    out = staged(rows.select(*_PLACE, "k1", "k2", "n", "p", "q", "ends", F.slice("all", F.lit(1), F.when(F.col("n") > 0, F.col("n") - _least(F.col("n")) + 2).otherwise(0)).alias("prefix")), "line-classes")
    unstage(found, levels)
    return out


def _parity() -> Column:
    """The parity of all tokens."""
    bit = lambda v: F.call_function("shiftleft", F.lit(1).cast("long"), v.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate("all", F.lit(0).cast("long"), lambda acc, v: acc.bitwiseXOR(bit(v)))


def _odd_parity() -> Column:
    """The parity of the tokens whose number has bit 6, of lines of more than WIDE tokens; 0 of others."""
    bit = lambda v: F.call_function("shiftleft", F.shiftright(v, 6).bitwiseAND(F.lit(1).cast("long")), v.bitwiseAND(F.lit(63)).cast("int"))
    return F.when(F.size("all") > WIDE, F.aggregate("all", F.lit(0).cast("long"), lambda acc, v: acc.bitwiseXOR(bit(v)))).otherwise(F.lit(0).cast("long"))


def _apart(n_a: Column, p_a: str, q_a: str, n_b: Column, p_b: str, q_b: str) -> Column:
    """The bits in which two classes' parities differ: of two wide lines in the halves of their tokens, else in all tokens."""
    every, odd = F.col(p_a).bitwiseXOR(F.col(p_b)), F.col(q_a).bitwiseXOR(F.col(q_b))
    return F.when((n_a > WIDE) & (n_b > WIDE), F.bit_count(every.bitwiseXOR(odd)) + F.bit_count(odd)).otherwise(F.bit_count(every))


def heads(found: DataFrame) -> DataFrame:
    """One row per class of lines with tokens: the place of its first line, n, prefix and parities.

    A line with a token that no other line has is a class of its own; the others' first lines are found by a window
    that Spark limits to one row a class before it shuffles.
    """
    some = found.filter("n > 0")
    alone = _lonely(F.get("prefix", F.lit(0)))
    copy = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(*_PLACE))
    return some.filter(alone).unionByName(some.filter(~alone).withColumn("copy", copy).filter("copy = 1").drop("copy"))


def _lonely(token: Column) -> Column:
    """Whether no other line has the token."""
    return F.shiftright(token, _HASH_BITS) <= _ALONE


def entries(first: DataFrame) -> DataFrame:
    """A row per class and prefix token, (g, k1, n, at, few, p, ...): g names the token.

    few: whether the place is in the shorter prefix (short) that a class needs as the smaller of a pair. Classes of
    fewer tokens than THRESHOLD's first number match no other. Tokens that no other line has are left out.
    """
    up, down = THRESHOLD
    some = first.filter(F.col("n") >= up).withColumn("reach", F.col("n") - _least(F.col("n")) + 1)
    some = some.withColumn("short", (F.col("n") - F.expr(f"(n * {2 * up} + {up + down - 1}) div {up + down}") + 1).cast("int"))
    rows = some.select("k1", "n", "p", "q", "settled", "reach", "short", "prefix", F.struct(*_PLACE).alias("place"), F.posexplode(F.slice("prefix", F.lit(1), F.col("reach"))).alias("at", "token")).filter(~_lonely(F.col("token")))
    return rows.select(F.xxhash64("token").alias("g"), "k1", "n", "at", (F.col("at") < F.col("short")).alias("few"), "p", "q", "settled", "reach", "short", "prefix", "place")


_ENTRY = ["g", "k1", "n", "at", "few", "p", "q", "settled"]


def _paired(rows: DataFrame, large: DataFrame, *more: str) -> DataFrame:
    """Entries of large groups entered under pairs instead: g of both tokens, the second's place less one.

    The second token is a later one of the prefix, or the next after it. more: columns of rows that go along.
    """
    met = rows.join(large, "g", "left_semi").withColumn("rest", F.expr("slice(prefix, at + 2, reach - at)"))
    both = F.transform("rest", lambda t, i: F.struct(F.xxhash64("g", t).alias("g"), (F.col("at") + i).alias("at"), (F.col("few") & (F.col("at") + i < F.col("short"))).alias("few")))
    return met.select("k1", "n", "p", "q", "settled", *more, F.explode(both).alias("e")).select("e.g", "k1", "n", "e.at", "e.few", "p", "q", "settled", *more)


def _cold(rows: DataFrame, crowded: DataFrame | None, still: DataFrame | None) -> DataFrame:
    """All entries, those of large groups under pairs, but for groups of pairs that are large still."""
    if crowded is None:
        return rows.select(*_ENTRY)
    both = _paired(rows, crowded)
    return rows.join(crowded, "g", "left_anti").select(*_ENTRY).unionByName(both if still is None else both.join(still, "g", "left_anti"))


def _side(rows: DataFrame, side: str, *more: str) -> DataFrame:
    """What is shuffled of a row: its group, its class, parities, and in one number whether it is settled and may be the smaller, size and place.

    more: the class's place as well, as at.
    """
    size = F.shiftleft(F.col("settled").cast("long"), 61).bitwiseOR(F.shiftleft(F.col("few").cast("long"), 60)).bitwiseOR(F.shiftleft(F.col("n").cast("long"), 30)).bitwiseOR(F.col("at").cast("long"))
    return rows.select("g", F.col("k1").alias(f"k_{side}"), size.alias(f"s_{side}"), F.col("p").alias(f"p_{side}"), F.col("q").alias(f"q_{side}"), *[F.col(c).alias(f"at_{side}") for c in more])


def _possible(smaller: bool) -> Column:
    """The length and positional filters and the parities' bound, of a pair of _side rows; smaller: a is the smaller of the two."""
    up, down = THRESHOLD
    low = F.lit((1 << 30) - 1)
    n_a, n_b = (F.shiftright(f"s_{x}", 30).bitwiseAND(low) for x in "ab")
    at_a, at_b = (F.col(f"s_{x}").bitwiseAND(low) for x in "ab")
    near = (n_a * down >= n_b * up) & (n_b * down >= n_a * up)
    enough = F.least(n_a - at_a, n_b - at_b) * (up + down) >= (n_a + n_b) * up
    apart = _apart(n_a, "p_a", "q_a", n_b, "p_b", "q_b")
    alike = apart * (up + down) <= (n_a + n_b) * (down - up)
    flag = lambda x, bit: F.shiftright(f"s_{x}", bit).bitwiseAND(F.lit(1)) == 1
    order = flag("a", 60) & ~(flag("a", 61) & flag("b", 61)) & ((n_a < n_b) | ((n_a == n_b) & (F.col("k_a") < F.col("k_b")))) if smaller else F.col("k_a") != F.col("k_b")
    return order & near & alike & enough


def _gap() -> Column:
    """How close a pair of _side rows may be by their parities, less what a match allows: the closest pairs have the least."""
    up, down = THRESHOLD
    n_a, n_b = (F.shiftright(f"s_{x}", 30).bitwiseAND(F.lit((1 << 30) - 1)) for x in "ab")
    return (_apart(n_a, "p_a", "q_a", n_b, "p_b", "q_b") * (up + down) - (n_a + n_b) * (down - up)).cast("int").alias("gap")


def pairs(some: DataFrame, every: DataFrame, after: str | None = None) -> DataFrame:
    """Pairs (k_a, k_b, gap) with n_a <= n_b of rows of one group, one of each side, that pass the filters.

    after: the side, a or b, whose place comes after the other's; rows have their place then.
    """
    if after is None:
        both = _side(some, "a").join(_side(every, "b"), "g").filter(_possible(True))
    else:
        order = F.col("at_a") > F.col("at_b") if after == "a" else F.col("at_b") > F.col("at_a")
        both = _side(some, "a", "place").join(_side(every, "b", "place"), "g").filter(order & _possible(True))
    return both.select("k_a", "k_b", _gap())


def _hint(df: DataFrame):
    return F.broadcast if df.count() <= BROADCAST_ROWS else (lambda x: x)


class Words:
    """The words of classes' first lines, read from the documents when they are asked for."""

    def __init__(self, documents: DataFrame, first: DataFrame):
        self.documents, self.first = documents, first

    def same(self, edges: DataFrame) -> DataFrame:
        """(k1) of those k of edges (k, e) whose lines match."""
        wanted = staged(edges.select(F.explode(F.array("k", "e")).alias("k1")).distinct().join(self.first.select("k1", *_PLACE), "k1"), "line-wanted")
        docs = wanted.groupBy(*_ID).agg(F.collect_list(F.struct("line_no", "k1")).alias("want")).withColumnsRenamed({"doc_id": "doc_", "key": "key_"})
        hint = _hint(wanted)
        here = F.col("doc_id").eqNullSafe(F.col("doc_")) & (F.col("key") == F.col("key_"))
        texts = self.documents.select("doc_id", F.xxhash64("text").alias("key"), "text").join(hint(docs), here)
        cut = texts.select("want", F.split("text", "\n").alias("lines")).select(F.explode("want").alias("w"), "lines").select("w.k1", F.get("lines", F.col("w.line_no")).alias("line"))
        words = staged(cut.dropDuplicates(["k1"]).select("k1", F.array_distinct(tokens(F.col("line"))).alias("all")), "line-words")
        both = edges.join(words.withColumnsRenamed({"k1": "k", "all": "a"}), "k").join(words.withColumnsRenamed({"k1": "e", "all": "b"}), "e")
        up, down = THRESHOLD
        found = staged(both.filter(F.size(F.array_intersect("a", "b")) * (up + down) >= (F.size("a") + F.size("b")) * up).select(F.col("k").alias("k1")).distinct(), "line-same")
        unstage(wanted, words)
        return found


def verified(words: Words, found: DataFrame, settled: DataFrame | None) -> DataFrame:
    """Of candidate pairs (k_a, k_b, gap) the later classes, settled ones aside, of those that match.

    Each class is compared with the closest candidate before it first; only where that doesn't match with the
    others before it. Near copies of one line all match a close one, so it is few that meet the others.
    """
    places = words.first.select("k1", F.struct(*_PLACE).alias("place"))
    a, b = (places.withColumnsRenamed({"k1": f"k_{x}", "place": f"at_{x}"}) for x in "ab")
    ends = found.distinct().join(a, "k_a").join(b, "k_b")
    pick = lambda x, y: F.when(F.col("at_a") < F.col("at_b"), F.col(x)).otherwise(F.col(y))
    edges = ends.select(pick("k_b", "k_a").alias("k"), F.least("at_a", "at_b").alias("at"), pick("k_a", "k_b").alias("e"), "gap")
    if settled is not None:
        edges = edges.join(_hint(settled)(settled.withColumnRenamed("k1", "k")), "k", "left_anti")
    edges = staged(edges, "line-candidates")
    least = edges.groupBy("k").agg(F.min(F.struct("gap", "at", "e")).alias("least")).select("k", "least.e")
    least = staged(least, "line-closest")
    done = words.same(least)
    rest = staged(edges.join(_hint(done)(done.withColumnRenamed("k1", "k")), "k", "left_anti").join(least, ["k", "e"], "left_anti").select("k", "e"), "line-rest")
    unstage(edges, least)
    more = words.same(rest)
    unstage(rest)
    return done.unionByName(more).distinct()


def _large(rows: DataFrame, large: int, part: int) -> DataFrame | None:
    """The groups (g) of more than so many classes, judged by one class in part; None if there are none."""
    some = rows.filter(F.pmod("k1", F.lit(part)) == 0).groupBy("g").agg(F.count("*").alias("size"))
    found = staged(some.filter(F.col("size") * part > large).select("g"), "line-groups")
    if found.isEmpty():
        return None
    return _hint(found)(found)


def _thinned(words: Words, crowd: DataFrame, rounds: int, settled: DataFrame) -> DataFrame:
    """The settled classes (k1) and those that match an earlier one, found by comparing each with one class a round.

    crowd: entries of large groups with place, the class's place. A group's classes are dealt to HUBS shares, and each
    share's first class is a hub; of the hubs before a class that pass the filters the closest is compared with it.
    Settled classes are no hubs later on.
    """
    for k in range(rounds):
        left = crowd.join(_hint(settled)(settled), "k1", "left_anti")
        share = F.pmod(F.xxhash64(F.lit(k), "k1"), F.lit(HUBS))
        hubs = left.groupBy("g", share.alias("share")).agg(F.min_by(F.struct("k1", "n", "at", "few", "p", "q", "settled", "place"), "place").alias("hub")).select("g", "hub.*")
        met = _side(left, "a", "place").join(_side(hubs, "b", "place"), "g").filter((F.col("at_a") > F.col("at_b")) & _possible(False))
        best = met.groupBy(F.col("k_a").alias("k")).agg(F.min(F.struct(_gap(), F.col("at_b"), F.col("k_b").alias("e"))).alias("hub"))
        edges = staged(best.select("k", "hub.e"), "line-hubs")
        found = words.same(edges)
        settled = staged(settled.unionByName(found), "line-settled")
        unstage(edges)
    return settled


def _settled(words: Words, members: DataFrame) -> DataFrame:
    """Of the classes (k1) in members those that match the earliest of them with the same two rarest tokens, or with the same ends."""
    up, down = THRESHOLD
    rows = words.first.join(_hint(members)(members), "k1", "left_semi")
    keys = F.explode(F.array(F.xxhash64(F.get("prefix", F.lit(0)), F.get("prefix", F.lit(1))), "ends"))
    rows = rows.select(keys.alias("g"), "k1", "n", "p", "q", F.struct(*_PLACE).alias("place"))
    hubs = rows.groupBy("g").agg(F.min_by(F.struct("k1", "n", "p", "q"), "place").alias("hub"), F.count("*").alias("m")).filter("m > 1").select("g", "hub")
    n = F.col("hub.n")
    apart = _apart(F.col("n"), "p", "q", n, "hub.p", "hub.q")
    near = (n * down >= F.col("n") * up) & (F.col("n") * down >= n * up) & (apart * (up + down) <= (n + F.col("n")) * (down - up))
    edges = staged(rows.join(hubs, "g").filter((F.col("k1") != F.col("hub.k1")) & near).select(F.col("k1").alias("k"), F.col("hub.k1").alias("e")).distinct(), "line-hubs")
    found = words.same(edges)
    unstage(edges)
    return found


def _marked(rows: DataFrame, settled: DataFrame, few: bool) -> DataFrame:
    """rows with what settled (k1) says in their column of that name; few: settled is broadcast."""
    flags = settled.withColumn("mark", F.lit(True))
    return rows.join(F.broadcast(flags) if few else flags, "k1", "left").withColumn("settled", F.col("mark").isNotNull()).drop("mark")


def later(words: Words, large: int = LARGE, rounds: int = ROUNDS) -> DataFrame:
    """The classes (k1) that an earlier class matches."""
    part = PART if large >= PART else 1
    first = words.first.withColumn("settled", F.lit(False))
    rows = entries(first)
    crowded = _large(rows, large, part)
    still = hot = settled = None
    if crowded is not None:
        still = _large(_paired(rows, crowded), large, part)
    if still is not None:
        crowd = staged(_paired(rows, crowded, "place").join(still, "g"), "line-crowd")
        members = staged(crowd.select("k1").distinct(), "line-members")
        settled = _settled(words, members)
        few = settled.count() <= BROADCAST_ROWS
        hot, first = staged(_marked(crowd, settled, few), "line-crowd"), _marked(first, settled, few)
        rows = entries(first if few else staged(first, "line-marked"))
        settled = _thinned(words, hot, rounds, settled)
        unstage(members, crowd)
    out = []
    # In PASSES over as many shares of the groups: no more than one share's rows are in shuffle files at once.
    for k in range(PASSES):
        cold = _cold(rows, crowded, still).filter(F.pmod("g", F.lit(PASSES)) == k)
        out.append(staged(pairs(cold, cold).distinct(), "line-pairs"))
    if hot is not None:
        left = hot.join(_hint(settled)(settled), "k1", "left_anti")
        # An unsettled class may be the smaller of a pair or the larger; the other one comes before it.
        out.append(staged(pairs(left, hot, "a").unionByName(pairs(hot, left, "b")).distinct(), "line-pairs"))
        unstage(hot)
    more = verified(words, reduce(DataFrame.unionByName, out), settled)
    unstage(*out)
    return more if settled is None else more.unionByName(settled).distinct()


def removals(documents: DataFrame) -> DataFrame:
    """One row per different document (doc_id, key): copies, n_lines, removed and filled, arrays of line numbers.

    removed: lines that an earlier line matches, which are all with tokens but the first ones of classes that no
    earlier class matches. filled: all lines with tokens. Each of the copies after the first loses the filled ones.
    """
    every = classes(documents)
    first = staged(heads(every), "line-heads")
    found = staged(every.select(*_PLACE, (F.col("n") > 0).alias("full")), "line-places")
    unstage(every)
    matched = staged(later(Words(documents, first)), "line-later")
    stay = first.join(_hint(matched)(matched), "k1", "left_anti").select(*_PLACE, F.lit(False).alias("full"), F.lit(True).alias("stays"))
    per = found.withColumn("stays", F.lit(False)).unionByName(stay).groupBy(*_ID).agg(
        F.count_if((F.col("line_no") == 0) & ~F.col("stays")).alias("copies"),
        F.count_if(~F.col("stays")).alias("rows"),
        F.collect_set(F.when(F.col("full"), F.col("line_no"))).alias("filled"),
        F.collect_set(F.when(F.col("stays"), F.col("line_no"))).alias("kept"),
    )
    gone = F.sort_array(F.array_except("filled", "kept")).alias("removed")
    out = staged(per.select(*_ID, "copies", F.expr("rows div copies").alias("n_lines"), gone, F.sort_array("filled").alias("filled")), "line-removals")
    unstage(found, first)
    return out


def clean(documents: DataFrame) -> DataFrame:
    """The documents without removed lines, all columns kept; a document that had lines with tokens and keeps none goes."""
    docs = documents.select(whole(documents), F.col("doc_id").alias("id_"), F.xxhash64("text").alias("hash_"))
    found = removals(documents).select(*[F.col(c).alias(f"{c}_") for c in ("doc_id", "key", "removed", "filled")])
    joined = docs.join(found, F.col("id_").eqNullSafe(F.col("doc_id_")) & (F.col("hash_") == F.col("key_")))
    copy = F.row_number().over(Window.partitionBy("doc_id_", "key_").orderBy("key_"))
    marked = joined.withColumn("gone_", F.when(copy == 1, F.col("removed_")).otherwise(F.col("filled_")))
    marked = marked.filter((F.size("filled_") == 0) | (F.size("gone_") < F.size("filled_")))
    text = F.col("whole_")["text"]
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone_", i)), "\n")
    changed = F.when(F.size("gone_") == 0, text).otherwise(kept).alias("text")
    return marked.select(*[changed if c == "text" else F.col("whole_")[c].alias(c) for c in documents.columns])


@tidy
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each document has and which of them go."""
    found = removals(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "removed", "filled", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    gone = F.when(F.col("copy") == 1, F.col("removed")).otherwise(F.col("filled"))
    return found.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed"))


OP5_SQL = r"""
WITH l AS (SELECT doc_id, line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\t\x0b\f\r]+'), lambda x: x <> ''))) AS w FROM
  (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
c AS (SELECT w, min((doc_id, line_no)) AS at, len(w) AS n FROM l WHERE len(w) > 0 GROUP BY w),
later AS (SELECT DISTINCT b.w FROM c a JOIN c b ON a.at < b.at AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4 WHERE len(list_intersect(a.w, b.w)) * 9 >= (a.n + b.n) * 4),
m AS (SELECT l.doc_id, l.line_no, len(l.w) > 0 AND (later.w IS NOT NULL OR c.at <> (l.doc_id, l.line_no)) AS gone FROM l LEFT JOIN c ON l.w = c.w LEFT JOIN later ON l.w = later.w)
SELECT doc_id, count(*) AS n_lines, CAST(coalesce(sum(CAST(gone AS INT)), 0) AS BIGINT) AS n_removed, coalesce(string_agg(CASE WHEN gone THEN CAST(line_no AS VARCHAR) END, ',' ORDER BY line_no), '') AS removed FROM m GROUP BY doc_id
"""
