"""Self-join of documents by the Jaccard similarity of word n-grams, through a token-group matrix.

Each document is the set of its shingles' 64-bit hashes.  Equal sets are one class from the start.

1. A class is searched by a prefix: sets of similarity ``t`` share at least ``l`` of the first
   ``n - ceil(t n) + l`` tokens under any fixed order, and the first token that they share is followed
   by enough others in both.  The first order is by hash; classes that share too few tokens with
   anybody are done.  Tokens in more than ``HOT`` prefixes are then moved to the end of the order, the
   most frequent last, so that passages which many documents share are only looked up for documents
   that hardly consist of anything else.
2. Similar documents become groups: every class is compared with the most central class of each of
   its token lists, and the links found join classes to groups.  A group of thousands of near copies
   costs one comparison a member, not one a pair.
3. The token-group matrix holds, for each group, the union of its members' prefix tokens.  Two groups
   qualify if their sizes fit and their unions overlap as any link between them needs; only qualifying
   groups are opened, and within them only members that overlap enough themselves are compared, set
   against set.

4. Every class has a sketch of 256 bits, each the parity of the tokens that fall to it.  Two sketches differ in no
   more bits than their sets differ in tokens, so pairs (and groups, by the sketch of one member and the distance of
   the farthest from it) whose sketches differ in more than a link allows are left out before a set is read, and in
   lists of more than ``WIDE`` groups before they are paired.

All comparisons are exact and a sketch only leaves out what cannot be linked, so every link between different groups is found.

Null and empty texts have no shingles and are linked with nothing.  Rows that repeat an id and a text
are one class; a null id is never the smallest; with no ids at all in a component its id is null.
Rows that share an id but not a text are separate.  Other columns do not matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut, drop_cut
from ..operators.graph import connected_components
from .common import keyed, let, same_key, sized

BLANKS, BREAK = " \t\n\x0b\f\r", "[\\x20\\x09-\\x0D]+"
HOT = 16
#: One more token must be shared for every so many in a set.
PROBE_EVERY = 25
#: Tokens stored per set, in prefixes.
SPARE = 1.5
#: Words of 64 bits in a sketch; groups in a list from which on its rows carry sketches.
SKETCH, WIDE = 4, 32


def shingle_words(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    trimmed = F.btrim(lowered, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BREAK)).otherwise(F.array().cast("array<string>"))


def tokens(text: Column, k: int) -> Column:
    """Sorted distinct hashes of the ``k``-word shingles; a shorter text is one shingle."""

    def of(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[w[i + j] for j in range(k)]))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= k, F.sort_array(F.array_distinct(each))).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(none)

    return let(shingle_words(text), of)


class Threshold:
    """Similarity of at least ``num / den``, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, n: Column) -> Column:
        """Fewest shared tokens of a set of ``n`` with a linked one."""
        return F.floor((n * self.num + (self.den - 1)) / self.den).cast("int")

    def probe(self, n: Column) -> Column:
        """Tokens that the prefixes of a linked pair share, by the size of the smaller set."""
        return (F.floor(n / PROBE_EVERY) + 1).cast("int")

    def prefix(self, n: Column) -> Column:
        return F.least(n, n - self.least(n) + self.probe(n)).cast("int")

    def overlap(self, a: Column, b: Column) -> Column:
        """Fewest shared tokens of a linked pair of sets of these sizes."""
        return F.floor(((a + b) * self.num + (self.num + self.den - 1)) / (self.num + self.den)).cast("int")

    def sizes_fit(self, a_low, a_high, b_low, b_high) -> Column:
        return (a_low * self.num <= b_high * self.den) & (b_low * self.num <= a_high * self.den)

    def apart(self, far: Column, a: Column, b: Column) -> Column:
        """Linked sets of at most these sizes differ in no more than ``far`` tokens."""
        return far * (self.num + self.den) <= (a + b) * (self.den - self.num)

    def holds(self, both: Column, a: Column, b: Column) -> Column:
        return self.den * both >= self.num * (a + b - both)


def sketch(tokens: Column) -> Column:
    """Per bit the parity of the tokens that fall to it."""
    words = [f"w{i}" for i in range(SKETCH)]
    empty = F.struct(*[F.lit(0).cast("long").alias(w) for w in words])

    def put(into: Column, token: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), token.bitwiseAND(F.lit(63)).cast("int"))
        place = F.shiftright(token, 6).bitwiseAND(F.lit(SKETCH - 1))
        return F.struct(*[F.when(place == i, into[w].bitwiseXOR(bit)).otherwise(into[w]).alias(w) for i, w in enumerate(words)])

    return F.aggregate(tokens, empty, put)


def differing(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ."""
    out = F.bit_count(x["w0"].bitwiseXOR(y["w0"]))
    for i in range(1, SKETCH):
        out = out + F.bit_count(x[f"w{i}"].bitwiseXOR(y[f"w{i}"]))
    return out


def signatures(docs: DataFrame, k: int, t: Threshold) -> DataFrame:
    """Stored per row: ``row`` (a number), ``__id, __th, n, s1, s2``, the sketch ``sk`` and the first tokens by hash order, ``SPARE`` prefixes."""
    sets = keyed(docs).select("__id", "__th", tokens(F.col("__text"), k).alias("t"))
    sized = sets.select("__id", "__th", "t", F.size("t").alias("n"))
    marks = [F.xxhash64("t").alias("s1"), F.xxhash64(F.lit(7), "t").alias("s2"), sketch(F.col("t")).alias("sk")]
    return cut(sized.select(F.monotonically_increasing_id().alias("row"), "__id", "__th", "n", *marks, F.slice("t", 1, F.ceil(t.prefix(F.col("n")) * F.lit(SPARE)).cast("int")).alias("head")), "sets")


def _shared_lists(postings: DataFrame) -> DataFrame:
    """Postings ``c, n, t`` of tokens with two classes or more, with ``df``."""
    df = postings.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return postings.join(df, "t").select("c", "n", "t", "df")


def _sharing(lists: DataFrame, t: Threshold) -> DataFrame:
    """Classes ``c`` that share as many prefix tokens, with whomever, as a linked pair does."""
    need = t.probe(t.least(F.col("n")))
    return lists.groupBy("c", "n").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= need).select("c")


def class_tokens(docs: DataFrame, wanted: DataFrame, k: int, repeats: bool) -> DataFrame:
    """Stored ``c, n, tokens`` of the wanted classes (stored ``c, n, __id, __th``), read from their texts again."""
    body, wanted = keyed(docs), sized(wanted)
    rows = body.join(wanted, same_key(body, wanted)).select("c", "n", tokens(body["__text"], k).alias("tokens"))
    return cut(rows.dropDuplicates(["c"]) if repeats else rows, "tokens")


def _hot_last(sets: DataFrame, hot: DataFrame, column: str) -> DataFrame:
    """``sets`` with the tokens of ``column`` that are not hot (``cold``) and that are (``warm``, rare ones first); those with any of the latter."""
    found = sets.select("c", F.explode(column).alias("t")).join(hot, "t").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "t")))["t"].alias("warm"))
    return sets.join(found, "c").withColumn("cold", F.array_except(column, "warm"))


def reordered(lists: DataFrame, wanted: DataFrame, docs: DataFrame, k: int, t: Threshold, repeats: bool) -> DataFrame:
    """Stored postings under the order that puts hot tokens last.

    ``c, n, t``; ``rest``: tokens of the set from this one on; ``cold``: the token is not hot; ``full``: no
    token of the prefix is; ``own``: share of tokens that are not hot.
    """
    hot = cut(lists.where(F.col("df") > HOT).select("t", "df").distinct(), "hot")
    touched = cut(lists.where(F.col("df") > HOT).select("c").distinct(), "touched")
    need = t.prefix(F.col("n"))
    share = F.size("cold") / F.greatest(F.size("cold") + F.size("warm"), F.lit(1))

    def placed(df: DataFrame, prefix: Column, n_cold: Column, own: Column) -> DataFrame:
        rows = df.select("c", "n", own.alias("own"), n_cold.alias("n_cold"), F.posexplode(prefix).alias("i", "t"))
        return rows.select("c", "n", "t", (F.col("n") - F.col("i")).alias("rest"), (F.col("i") < F.col("n_cold")).alias("cold"), (F.col("n_cold") >= need).alias("full"), "own")

    moved = lambda df: placed(df, F.slice(F.concat("cold", "warm"), 1, need), F.size("cold"), share)
    heads = cut(_hot_last(wanted.join(touched, "c", "left_semi"), hot, "head"), "heads")
    enough = (F.size("cold") >= need) | (F.size("head") == F.col("n"))
    # the stored tokens do not hold a whole prefix without the hot ones: read the text again
    lacking = cut(heads.where(~enough).select("c", "n", "__id", "__th"), "lacking")
    rest = _hot_last(class_tokens(docs, lacking, k, repeats), hot, "tokens")
    same = placed(wanted.join(touched, "c", "left_anti"), F.slice("head", 1, need), F.col("n"), F.lit(1.0))
    return cut(moved(heads.where(enough)).unionByName(moved(rest)).unionByName(same), "postings")


def near(pairs: DataFrame, searched: DataFrame, t: Threshold) -> DataFrame:
    """Stored pairs ``a, b`` of ``pairs`` whose sketches leave a link possible."""
    for end in ("a", "b"):
        pairs = pairs.join(searched.select(F.col("c").alias(end), F.col("n").alias(f"{end}_n"), F.col("sk").alias(f"{end}_sk")), end)
    return cut(pairs.where(t.apart(differing(F.col("a_sk"), F.col("b_sk")), F.col("a_n"), F.col("b_n"))).select("a", "b"), "near")


def compare(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """Stored ``src, dst`` of the pairs ``a, b`` whose sets are similar enough."""
    left = sets.select(F.col("c").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("c").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).alias("m"))
    return cut(both.where(t.holds(F.col("m"), F.col("na"), F.col("nb"))).select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")


def star_pairs(postings: DataFrame, t: Threshold) -> DataFrame:
    """Each class with the most central class of each of its token lists: the one with the fewest tokens of its own.

    These pairs only serve to form groups, so those that share few tokens are left to the matrix.
    """
    centre = postings.groupBy("t").agg(F.min(F.struct("own", "c", "n")).alias("m"), F.count(F.lit(1)).alias("df")).where("df > 1")
    met = postings.join(centre.select("t", "m.c", "m.n").toDF("t", "b", "nb"), "t").where(F.col("c") != F.col("b"))
    counted = met.where(t.sizes_fit(F.col("n"), F.col("n"), F.col("nb"), F.col("nb"))).groupBy(F.col("c").alias("a"), "b").agg(F.count(F.lit(1)).alias("m"), F.max(F.least("n", "nb")).alias("n"))
    return counted.where(2 * F.col("m") >= t.probe(F.col("n"))).select("a", "b")


def group_matrix(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """Stored token-group matrix: per group and token of its union ``g, t, rest, cold`` (the longest rest of a
    member), and the group's sizes ``low, high`` and whether all prefixes are ``full``."""
    named = postings.join(groups, "c", "left").withColumn("g", F.coalesce("g", "c"))
    union = named.groupBy("g", "t").agg(F.max("rest").alias("rest"), F.max("cold").alias("cold"))
    about = named.groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("full").alias("full"))
    return cut(union.join(about, "g"), "matrix")


def group_sketches(searched: DataFrame, groups: DataFrame) -> DataFrame:
    """Stored per group: ``g``, sizes ``low, high``, members ``k``, the sketch ``sk`` of a member and the distance ``wide`` of the farthest from it."""
    members = searched.select("c", "n", "sk").join(groups, "c", "left").withColumn("g", F.coalesce("g", "c"))
    centre = members.where("c = g").select("g", F.col("sk").alias("centre"))
    far = differing(F.col("sk"), F.col("centre"))
    about = [F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("k"), F.first("centre").alias("sk"), F.max(far).cast("int").alias("wide")]
    return cut(members.join(centre, "g").groupBy("g").agg(*about), "sketches")


def _may_link(t: Threshold) -> Column:
    """Whether the sketches of the groups ``a`` and ``b`` leave a link between members possible."""
    far = differing(F.col("a_sk"), F.col("b_sk")) - F.col("a_wide") - F.col("b_wide")
    return t.apart(far, F.col("a_high"), F.col("b_high"))


def _met(left: DataFrame, right: DataFrame, on: list[str], t: Threshold, sketched: bool) -> DataFrame:
    """Tokens at which pairs ``a, b`` of groups (or members) meet and may be linked; with ``sketched`` the rows carry sketches.

    The first token that a linked pair shares leaves as many tokens in both as the pair must share; the
    others leave as many less one each.  Hot tokens only count if they can be that first one.
    """
    bits = ("sk", "wide") if sketched else ()
    a = left.select(*on, F.col("g").alias("a"), "cold", *[F.col(c).alias(f"a_{c}") for c in ("low", "high", "rest", "full", *bits)])
    b = right.select(*on, F.col("g").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("low", "high", "rest", "full", *bits)])
    least = t.overlap(F.col("a_low"), F.col("b_low"))
    spare = t.probe(F.least("a_high", "b_high")) - 1
    first = (F.col("a_rest") >= least) & (F.col("b_rest") >= least)
    later = F.col("cold") & (F.col("a_rest") >= least - spare) & (F.col("b_rest") >= least - spare)
    fit = t.sizes_fit(F.col("a_low"), F.col("a_high"), F.col("b_low"), F.col("b_high"))
    possible = (F.col("a") < F.col("b")) & fit & (first | later)
    met = a.join(b, on).where(possible & _may_link(t) if sketched else possible)
    return met.select("a", "b", "cold", first.alias("first"), (F.col("a_full") & F.col("b_full")).alias("full"), t.probe(F.least("a_low", "b_low")).alias("need"))


def _overlapping(met: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that share a possible first token and, if neither prefix holds a hot token, as many as ``probe`` says."""
    told = met.groupBy("a", "b").agg(F.max("first").alias("first"), F.count_if("cold").alias("m"), F.min("full").alias("full"), F.first("need").alias("need"))
    return told.where(F.col("first") & (~F.col("full") | (F.col("m") >= F.col("need")))).select("a", "b")


def qualifying(matrix: DataFrame, sketches: DataFrame, t: Threshold) -> DataFrame:
    """Stored pairs of groups ``a, b`` that may hold a link, and their members ``ka, kb``: sizes fit, the unions overlap
    enough and the sketches are near enough."""
    counts = cut(matrix.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    lists = matrix.join(counts.where(F.col("df") <= WIDE).select("t"), "t", "left_semi")
    met = _met(lists, lists, ["t"], t, False)
    wide = counts.where(F.col("df") > WIDE).select("t")
    if not wide.isEmpty():
        rows = matrix.join(wide, "t", "left_semi").join(sketches.select("g", "sk", "wide"), "g")
        met = met.unionByName(_met(rows, rows, ["t"], t, True))
    pairs = _overlapping(met)
    for end in ("a", "b"):
        pairs = pairs.join(sketches.select(*[F.col(c).alias(end if c == "g" else f"{end}_{c}") for c in ("g", "high", "k", "sk", "wide")]), end)
    return cut(pairs.where(_may_link(t)).select("a", "b", F.col("a_k").alias("ka"), F.col("b_k").alias("kb")), "qualifying")


def opened(postings: DataFrame, groups: DataFrame, searched: DataFrame, sketches: DataFrame, pairs: DataFrame, t: Threshold) -> DataFrame:
    """Members ``a, b`` of qualifying groups that overlap enough themselves; groups of one are their member."""
    single = pairs.where("ka = 1 and kb = 1").select("a", "b")
    wide = pairs.where("ka > 1 or kb > 1").select(F.col("a").alias("ga"), F.col("b").alias("gb"))
    both_ways = wide.unionByName(wide.select(F.col("gb").alias("ga"), F.col("ga").alias("gb")))
    members = searched.join(groups, "c", "left").select(F.coalesce("g", "c").alias("ga"), "c", F.col("n").alias("a_high"), F.col("sk").alias("a_sk"), F.lit(0).alias("a_wide"))
    other = sketches.select(F.col("g").alias("gb"), F.col("high").alias("b_high"), F.col("sk").alias("b_sk"), F.col("wide").alias("b_wide"))
    # members that are near enough to a group of the other side
    facing = cut(both_ways.join(members, "ga").join(other, "gb").where(_may_link(t)).select("ga", "gb", "c", F.col("a_sk").alias("sk")), "facing")
    named = lambda rows: rows.join(postings, "c").select("gb", F.col("c").alias("g"), "t", "rest", "cold", "full", F.col("n").alias("low"), F.col("n").alias("high"), "sk", F.lit(0).alias("wide"))
    right = facing.select(F.col("ga").alias("gb"), "c", "sk").dropDuplicates(["c"])
    return single.unionByName(_overlapping(_met(named(facing), named(right), ["gb", "t"], t, True)))


def _repeated(rows: DataFrame) -> DataFrame:
    return rows.groupBy("__id", "__th").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(*pairs.columns)).alias("c")).distinct()


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Per row ``doc_id, __th, n_shingles, component_id`` and ``group_id``, a number of the component (null without shingles)."""
    t = Threshold(num, den)
    heads = signatures(docs, k, t)
    rows = cut(heads.drop("head", "sk"), "rows")
    classes = cut(rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("row").alias("c"), F.min("__id").alias("first_id")), "classes")
    repeats = not _repeated(rows).isEmpty()
    own = heads.join(classes.select(F.col("c").alias("row")), "row", "left_semi")
    lists = cut(_shared_lists(own.select(F.col("row").alias("c"), "n", F.explode(F.slice("head", 1, t.prefix(F.col("n")))).alias("t"))), "lists")
    wanted = cut(heads.join(_sharing(lists, t), F.col("row") == F.col("c")).select("c", "n", "__id", "__th", "sk", "head"), "wanted")
    drop_cut(heads)
    ordered = reordered(lists.join(wanted.select("c"), "c", "left_semi"), wanted.drop("sk"), docs, k, t, repeats)
    drop_cut(lists)
    # the same test once more: passages that many share no longer count
    searched = cut(wanted.drop("head").join(_sharing(_shared_lists(ordered), t), "c"), "searched")
    postings = cut(ordered.join(searched.select("c"), "c", "left_semi"), "postings")
    for stored in (wanted, ordered):
        drop_cut(stored)

    def sets_of(pairs: DataFrame) -> DataFrame:
        return class_tokens(docs, cut(searched.join(_ends(pairs), "c", "left_semi"), "asked"), k, repeats)

    stars = cut(star_pairs(postings, t), "stars")
    asked = near(stars, searched, t)
    sets = sets_of(asked)
    first = compare(asked, sets, t)
    drop_cut(sets)
    groups = cut(connected_components(first).toDF("c", "g"), "groups")
    matrix, sketches = group_matrix(postings, groups), group_sketches(searched, groups)
    # pairs that were compared already, or lay too far apart, are not links
    found = opened(postings, groups, searched, sketches, qualifying(matrix, sketches, t), t)
    pairs = cut(found.join(stars, ["a", "b"], "left_anti").join(stars.toDF("b", "a"), ["a", "b"], "left_anti"), "opened")
    sets = sets_of(pairs)
    more = compare(pairs, sets, t)
    for stored in (sets, postings, matrix):
        drop_cut(stored)
    joined = cut(connected_components(first.unionByName(more)).toDF("c", "g"), "groups")
    member = cut(classes.join(joined, "c", "left").select("n", "s1", "s2", "first_id", F.coalesce("g", "c").alias("group_id")), "members")
    named = member.groupBy("group_id").agg(F.min("first_id").alias("component_id"))
    told = member.join(named, "group_id").select("n", "s1", "s2", "component_id", "group_id")
    full = rows.join(told, ["n", "s1", "s2"], "left")
    return full.select(
        F.col("__id").alias("doc_id"), "__th", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("__id")).alias("component_id"), "group_id",
    )


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (of equal ids the smallest text hash).

    Texts without words are linked with nothing, so they all stay; of rows that repeat an id and a text one stays.
    """
    found = cut(jaccard_components(docs, k, num, den).where("n_shingles > 0").select(F.col("doc_id").alias("__id"), "__th", "group_id"), "components")
    best = found.groupBy("group_id").agg(F.min(F.struct(F.col("__id").isNull().alias("no"), "__id", "__th")).alias("m"))
    stay = best.select("group_id", F.col("m.__id").alias("__id"), F.col("m.__th").alias("__th"))
    same = found["group_id"].eqNullSafe(stay["group_id"]) & same_key(found, stay)
    gone = sized(cut(found.join(stay, same, "left_anti").select("__id", "__th").distinct(), "copies"))
    marked = docs.withColumn("__row_th", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    is_row = lambda x: marked["doc_id"].eqNullSafe(x["__id"]) & (marked["__row_th"] == x["__th"])
    left = marked.join(gone, is_row(gone), "left_anti")
    again = cut(_repeated(found), "repeated")
    if not again.isEmpty():
        once = left.join(again, left["doc_id"].eqNullSafe(again["__id"]) & (left["__row_th"] == again["__th"]), "left_semi").dropDuplicates(["doc_id", "__row_th"])
        left = left.join(again, left["doc_id"].eqNullSafe(again["__id"]) & (left["__row_th"] == again["__th"]), "left_anti").unionByName(once)
    return left.drop("__row_th")
