"""URL rules by a Bloom filter cascade (DataFrame functions only).

A rule is a host and a path with an action.  It fits its host and all subdomains
where the path of the url starts with the rule's; the longest fitting rule wins.
So a url asks for few keys: the last n labels of its host followed by the first m
letters of its path, for every shape (n, m) that a rule has.  Which of these keys
are rules is answered by cascades, one per action, without a join:

* level 1 is a Bloom filter of the listed keys;
* level 2 holds the false positives of level 1, found over the keys of all urls of
  the corpus, level 3 the listed keys that pass level 2, and so on, until none is left.

A key is listed if the first level that refuses it is an even one.  Since the
false positives come from the complete universe of keys, the answer is exact for
every url of the corpus (not for urls that were not there when it was built).

Sizes follow the counts: of r listed keys among u, level 1 has a false positive rate
of about ``r / (u * sqrt(2))``, later levels of a half, which keeps a cascade to
a few bits for a listed key.  A key sets all its bits in one 64-bit word, so a level costs
one lookup.  Only keys that pass level 1 are shuffled, combined before the shuffle,
so a host that holds a third of all rows is one key per task.  A cascade is one
row of words, sent to the executors as a scalar subquery.  It is counted first: past
``MAX_WORDS`` the listed keys are found by an equality join of the keys that passed
level 1 instead, so no rule is left out.

Defined results: a url without ``://`` or null has an empty host and path; an empty
host fits no rule; a rule without a host, with a null path (counted as empty) or
listed twice counts once, and of two actions for one key ``block`` holds; no
fitting rule: null and ``allow``, since the url is on no list; repeated rows
and null ids each give their row; an empty table or no rules give what follows from
this; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import ascii_lower, stored, table, text_of

#: Host, path and action of the rules of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Words of 64 bits of a level that may be sent to every executor (64 MB).
MAX_WORDS = 1 << 23
#: Bits a key sets in its word, at most.
MAX_BITS = 8
#: Shapes of rules that one projection tests; more are exploded into rows.
MAX_SHAPES = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    text = text_of(url)
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.char_length(text))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_keys(rules: DataFrame) -> DataFrame:
    """One row per key: key, labels, letters (its shape), host_letters, action."""
    host = ascii_lower(text_of(F.col("host")))
    path = text_of(F.col("path"))
    return (
        rules.select(host.alias("_h"), path.alias("_p"), F.col("action").alias("_a")).where("_h <> '' and _a in ('allow', 'block')")
        .groupBy("_h", "_p").agg(F.max("_a").alias("action"))
        .select(F.concat("_h", "_p").alias("key"), F.size(F.split("_h", r"\.")).alias("labels"),
                F.char_length("_p").alias("letters"), "action")
    )


def asked_key(labels: int | Column, letters: int | Column) -> Column:
    """The key of a shape that a row with ``host`` and ``path`` asks for, or null."""
    n, m = (x if isinstance(x, Column) else F.lit(x) for x in (labels, letters))
    host_labels = F.char_length("host") - F.char_length(F.replace("host", F.lit("."), F.lit(""))) + 1
    fits = (F.col("host") != "") & (host_labels >= n) & (F.char_length("path") >= m)
    suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -n)
    return F.when(fits, F.concat(suffix, F.substring("path", F.lit(1), m)))


class Level:
    """A Bloom filter of one 64-bit word per key: ``words`` words, ``bits`` bits a key."""

    def __init__(self, keys: DataFrame, number: int, words: int, bits: int):
        self.number, self.words, self.bits = number, words, bits
        spark = keys.sparkSession
        empty = spark.range(words).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("x"))
        key = F.col("key")
        # Every word is there, so the array is read by position; its size was counted beforehand.
        filled = keys.select(self._word(key).alias("w"), self._mask(key).alias("x")).unionByName(empty)
        filled = filled.groupBy("w").agg(F.bit_or("x").alias("x"))
        packed = filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "x"))), lambda s: s["x"]).alias("filter"))
        self.table = stored(packed, f"cascade-{number}")

    def _hash(self, key: Column, salt: int) -> Column:
        return F.xxhash64(F.lit(self.number * 1000 + salt), key)

    def _word(self, key: Column) -> Column:
        return F.pmod(self._hash(key, 0), F.lit(self.words).cast("bigint"))

    def _mask(self, key: Column) -> Column:
        """``bits`` bits, six hash bits each."""
        one, mask = F.lit(1).cast("bigint"), None
        for i in range(self.bits):
            at = F.shiftright(self._hash(key, 1 + i // 8), 6 * (i % 8)).bitwiseAND(F.lit(63).cast("bigint")).cast("int")
            bit = F.call_function("shiftleft", one, at)
            mask = bit if mask is None else mask.bitwiseOR(bit)
        return mask

    def passes(self, key: Column) -> Column:
        word = F.get(self.table.scalar(), self._word(key).cast("int"))
        mask = self._mask(key)
        return word.bitwiseAND(mask) == mask


def level_size(keys: int, rate: float) -> tuple[int, int]:
    """Words and bits a key for a false positive rate, as of an unblocked filter."""
    bits = min(MAX_BITS, max(1, math.ceil(-math.log2(rate))))
    return max(1, math.ceil(keys * -math.log(rate) / math.log(2) ** 2 / 64)), bits


class Cascade:
    """Exact membership in ``listed`` (a column ``key``) for all keys of ``universe``
    (``key``, repeats allowed); ``in_list`` is an expression without joins."""

    def __init__(self, listed: DataFrame, universe: DataFrame, universe_size: int, rate: float | None = None):
        self.levels: list[Level] = []
        n = listed.count()
        if not n:
            return
        rate = rate or min(0.5, max(2.0 ** -24, n / (max(1, universe_size) * math.sqrt(2))))
        size, bits = level_size(n, rate)
        self.levels.append(Level(listed, 1, size, bits))
        # Keys of the corpus that pass level 1: listed ones and the false positives.
        passed = universe.where(self.levels[0].passes(F.col("key"))).select("key", F.lit(0).alias("listed"))
        marked = passed.unionByName(listed.select("key", F.lit(1).alias("listed")))
        wrong = stored(marked.groupBy("key").agg(F.max("listed").alias("listed")).where("listed = 0").select("key"), "cascade-fp")
        held, other = wrong, listed
        while (n := held.count()):
            level = Level(held, len(self.levels) + 1, level_size(n, 0.5)[0], 1)
            self.levels.append(level)
            # The other side's keys that this level lets pass go into the next one.
            held, other = stored(other.where(level.passes(F.col("key"))), "cascade-rest"), held

    def in_list(self, key: Column) -> Column:
        """Whether ``key`` is listed; null keys are not."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(~level.passes(key), level.number % 2 == 0).otherwise(answer)
        return key.isNotNull() & answer


def _asked(urls: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """All keys that the urls ask for."""
    each = F.array_compact(F.array(*[asked_key(n, m) for n, m in shapes]))
    return urls.select(F.explode(each).alias("key"))


def _by_join(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The winning rule of each row (``_row``) by an equality join on the keys, for
    lists whose filters are too large to send, or of many shapes."""
    shapes = keys.select("labels", "letters").distinct().agg(F.collect_list(F.struct("labels", "letters")).alias("s"))
    with_shapes = rows.withColumn("_shape", F.explode(shapes.scalar()))
    asked = with_shapes.select("_row", asked_key(F.col("_shape.labels"), F.col("_shape.letters")).alias("key"),
                               F.col("_shape.labels").alias("_n")).where("key is not null")
    order = F.struct(F.char_length("key").alias("n"), F.col("_n").alias("l"), F.col("key"), F.col("action"))
    best = asked.join(keys.select("key", "labels", "action"), (F.col("_n") == F.col("labels")) & (asked["key"] == keys["key"])) \
        .select("_row", asked["key"].alias("key"), "_n", "action").groupBy("_row").agg(F.max(order).alias("_best"))
    return rows.join(best, "_row", "left").select(*columns, "_best")


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
           rate: float | None = None, max_words: int = MAX_WORDS, max_shapes: int = MAX_SHAPES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.  ``rate`` sets the false
    positive rate of level 1 (by default from the counts)."""
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    keys = stored(rule_keys(rules), "rules")
    count, n_shapes = keys.agg(F.count(F.lit(1)), F.count_distinct("labels", "letters")).first()
    columns = ["_id", "host", "path"]
    if n_shapes > max_shapes or level_size(count, 2.0 ** -24)[0] > max_words:
        best = _by_join(stored(urls.withColumn("_row", F.uuid()), "urls"), keys, columns)
    else:
        best = urls.withColumn("_best", _winner(urls, keys, rate))
    return best.select(
        F.col("_id").alias(id_col), "host", "path", F.col("_best.key").alias("rule"),
        F.coalesce("_best.action", F.lit("allow")).alias("verdict"))


def _winner(urls: DataFrame, keys: DataFrame, rate: float | None) -> Column:
    """The longest listed key of a row with its action, as a struct."""
    shapes = [tuple(r) for r in keys.select("labels", "letters").distinct().orderBy("labels", "letters").collect()]
    fitting = []
    if shapes:
        asked = _asked(urls, shapes)
        universe = asked.agg(F.approx_count_distinct("key")).first()[0]
        for action in ("allow", "block"):
            listed = keys.where(F.col("action") == action)
            cascade = Cascade(listed.select("key"), asked, universe, rate)
            there = {tuple(r) for r in listed.select("labels", "letters").distinct().collect()}
            for n, m in sorted(there):
                key = asked_key(n, m)
                fitting.append(F.when(cascade.in_list(key), F.struct(
                    F.char_length(key).alias("n"), F.lit(n).alias("l"), key.alias("key"), F.lit(action).alias("action"))))
    none = F.lit(None).cast("struct<n:int,l:int,key:string,action:string>")
    return F.greatest(none, none, *fitting)


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, action string")


def op13_url_cascade(spark, sf_dir):
    return judged(table(spark, sf_dir, "pages"), rules_table(spark))


OP13_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
