"""URL filtering by association rules.

A URL gives tokens: its scheme, its host's labels and suffixes, its path's segments (digits as one
token), file ending, query names and fragment mark. Spark's FP-growth mines the token combinations of labelled URLs
that have the label "bad". A rule passes if enough bad URLs have it (``MIN_SUPPORT``), enough of the URLs that have it are
bad (``MIN_CONFIDENCE``, and at most half the share of good URLs that there is without it), and chance doesn't explain
that (the lower end of Wilson's interval at ``Z`` deviations is above the share of bad URLs). A rule that contains
another can't block anything more and is dropped. A URL is blocked if it has all tokens of some rule: an inverted index
lists each rule under its rarest token, so a URL looks only at the rules of its own tokens.

What FP-growth has to go through is bounded without leaving tokens out. Tokens that the same fitted URLs have (the
segments of one long path, say) are one item; a URL has an item if it has any of its tokens. A URL of more than
``FIT_ITEMS`` frequent items is dealt into overlapping baskets of that size, so that every ``COVER`` of its items meet in some
basket; as a combination may then be mined several times, what is mined are candidates, which are counted over
all fitted URLs. So rules of up to COVER items are complete, and longer ones as far as URLs have FIT_ITEMS items or fewer.

Explicit (host, path) rules come first: a rule fits its host and all subdomains if the URL's path starts with the
rule's; the longest rule, host and path together, wins, and of equally long ones that of the longer host. Hosts, paths
and these rules are built-in expressions; only mined rules, if there are any, go through Arrow batches.

The classifier is fitted on about ``FIT_ROWS`` labelled URLs at most (those of the smallest hash). Judging covers every row
and whole URLs, row by row, without a shuffle.

Defined results: a null URL or one without ``://`` has an empty host and path, no tokens, and is
allowed. Repeated rows stay. Null ids stay. Without labels there are no rules. Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import ascii_lower, in_batches, materialise

FIT_ROWS = 200_000
FIT_ITEMS = 12
COVER = 3
MIN_SUPPORT = 0.002
MIN_COUNT = 3
MIN_CONFIDENCE = 0.8
Z = 3.0
_ALPHA = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_NUMBER = re.compile(r"[0-9]+")
#: Scheme, host and path.
_URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)"


def split_url(url: str | None) -> tuple[str, str, str, str]:
    """Scheme, host (A-Z lower-cased), path, and what follows the path; all empty without ``://``."""
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = rest[:end].translate(_ALPHA), rest[end:]
    end = next((i for i, c in enumerate(rest) if c in "?#"), len(rest))
    return scheme, host, rest[:end], rest[end:]


def url_tokens(url: str | None) -> list[str]:
    """Distinct tokens of a URL, in the order they come. A host of very many labels has the suffixes of its last eight."""
    scheme, host, path, rest = split_url(url)
    if not host and not path and not scheme:
        return []
    labels = [x for x in host.split(".") if x]
    out = [f"scheme={scheme.translate(_ALPHA)}"] + [f"label:{x}" for x in labels]
    out += [f"host:{'.'.join(labels[i:])}" for i in range(max(0, len(labels) - 8), len(labels) - 1)]
    out += [f"word:{w}" for x in labels for w in x.split("-") if w != x and w]
    segments = [x for x in path.translate(_ALPHA).split("/") if x]
    out += [f"path:{_NUMBER.sub('0', x)}" for x in segments]
    if segments and "." in segments[-1]:
        out.append(f"ending:{segments[-1].rpartition('.')[2]}")
    if path.endswith("/"):
        out.append("path=folder")
    query, _, fragment = rest.removeprefix("?").partition("#") if rest.startswith("?") else ("", "", rest[1:])
    out += [f"query:{x.partition('=')[0]}" for x in query.split("&") if x]
    if fragment:
        out.append("fragment")
    return list(dict.fromkeys(out))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(urls):
    return urls.map(url_tokens)


@dataclass
class Mined:
    """Rules (items, confidence, bad URLs that have it) and the item of each token that a rule may ask for."""

    rules: list[tuple[tuple[str, ...], float, int]]
    item_of: dict[str, str]

    def spelled_out(self) -> dict[tuple[str, ...], tuple[float, int]]:
        """Every rule in tokens, with its confidence and count; one of items stands for each choice of their tokens."""
        tokens = defaultdict(list)
        for token, item in self.item_of.items():
            tokens[item].append(token)
        return {tuple(sorted(choice)): (c, n) for rule, c, n in self.rules for choice in itertools.product(*(tokens[i] for i in rule))}


def passes(bad: int, n: int, all_bad: int, total: int) -> bool:
    """Whether a combination that n of the fitted URLs have, bad of them labelled so, is a rule."""
    if n == 0 or bad < least_count(total):
        return False
    base, share = all_bad / total, bad / n
    low = (share + Z * Z / (2 * n) - Z * math.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    return share >= max(MIN_CONFIDENCE, (1 + base) / 2) and low > base


def least_count(total: int) -> int:
    return max(MIN_COUNT, math.ceil(MIN_SUPPORT * total))


def baskets_of(items: list[str]) -> Iterator[list[str]]:
    """The items themselves, or overlapping parts of ``FIT_ITEMS`` at most in which every COVER of them meet."""
    if len(items) <= FIT_ITEMS:
        yield items
        return
    size = FIT_ITEMS // COVER
    groups = [items[i : i + size] for i in range(0, len(items), size)]
    for chosen in itertools.combinations(groups, COVER):
        yield [x for g in chosen for x in g]


def _fitted(labelled: DataFrame) -> DataFrame:
    """rid, bad and tokens of the labelled URLs to fit on."""
    rows = labelled.select("url", F.coalesce("bad", F.lit(False)).alias("bad"), F.monotonically_increasing_id().alias("rid"))
    rows = materialise(rows, "labelled-urls")
    total = rows.count()
    if total > FIT_ROWS:  # hashes run evenly over all longs
        rows = rows.where(F.xxhash64("url", "rid") < math.floor(2.0**64 * FIT_ROWS / total) - 2**63)
    return materialise(rows.select("rid", "bad", _tokens("url").alias("tokens")).where(F.size("tokens") > 0), "url-tokens")


def mine(labelled: DataFrame) -> Mined:
    """The rules for the label, from columns url and bad (boolean)."""
    fitted = _fitted(labelled)
    total, all_bad = fitted.agg(F.count("*"), F.count_if("bad")).first()
    least = least_count(total)
    if all_bad < least:
        return Mined([], {})
    spark = fitted.sparkSession
    # tokens that enough bad URLs have; equal sets of URLs are told by their number and two sums of hashes
    each = fitted.select("rid", "bad", F.explode("tokens").alias("token"))
    sums = [F.sum(F.xxhash64("rid", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}") for k in range(2)]
    tokens = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), *sums).where(F.col("bad") >= least)
    grouped = tokens.groupBy("n", "s0", "s1").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    # at most the fitted URLs' tokens over ``least``
    item_of = {t: r.tokens[0] for r in grouped.select("tokens").collect() for t in r.tokens}

    def items(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [sorted({item_of[t] for t in ts if t in item_of}) for ts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["bad", "items"])

    urls = materialise(in_batches(fitted.select("bad", "tokens"), items, "bad boolean, items array<string>"), "url-items")

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for found in batch.column(0).to_pylist():
                made = pa.array(list(baskets_of(found)), pa.list_(pa.string()))
                for at in range(0, len(made), 10_000):
                    yield pa.RecordBatch.from_arrays([made.slice(at, 10_000)], names=["items"])

    baskets = in_batches(urls.where("bad AND size(items) > 0").select("items"), parts, "items array<string>")
    baskets = materialise(baskets, "url-baskets")
    n_baskets = baskets.count()
    if n_baskets == 0:
        return Mined([], {})
    support = max(0.0, (least - 0.5) / n_baskets)
    model = FPGrowth(itemsCol="items", minSupport=support, numPartitions=8).fit(baskets)
    candidates = [tuple(sorted(r["items"])) for r in model.freqItemsets.select("items").collect()]
    return Mined(prune(_passing(urls, candidates, all_bad, total)), item_of)


def _passing(urls: DataFrame, candidates: list[tuple[str, ...]], all_bad: int, total: int) -> list[tuple[tuple[str, ...], float, int]]:
    """The candidates that pass, counted over all fitted URLs."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(candidates)
        n, bad = Counter(), Counter()
        for batch in it:
            for is_bad, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                met = index.matches(found)
                n.update(met)
                if is_bad:
                    bad.update(met)
        keys = list(n)
        columns = [pa.array(keys, pa.int64()), pa.array([n[k] for k in keys], pa.int64()), pa.array([bad[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["rule", "n", "bad"])

    counted = in_batches(urls, count, "rule long, n long, bad long").groupBy("rule").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    found = [(candidates[r.rule], r.bad, r.n) for r in counted.collect()]
    return [(rule, bad / n, bad) for rule, bad, n in found if passes(bad, n, all_bad, total)]


def prune(rules: list[tuple[tuple[str, ...], float, int]]) -> list[tuple[tuple[str, ...], float, int]]:
    """Without rules that contain all items of another."""
    kept: list[tuple[tuple[str, ...], float, int]] = []
    index = RuleIndex([])
    for rule in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        if not index.match(rule[0]):
            index.add(rule[0], min(rule[0]))
            kept.append(rule)
    return kept


class RuleIndex:
    """Rules by their rarest item."""

    def __init__(self, rules: list[tuple[str, ...]]):
        common = Counter(t for r in rules for t in r)
        self.by_item: dict[str, list[tuple[frozenset, int]]] = defaultdict(list)
        self.size = 0
        for rule in rules:
            self.add(rule, min(rule, key=lambda t: (common[t], t)))

    def add(self, rule: tuple[str, ...], item: str) -> None:
        self.by_item[item].append((frozenset(rule), self.size))
        self.size += 1

    def matches(self, items: Iterable[str]) -> list[int]:
        """Numbers of the rules that the items hold."""
        have = set(items)
        return [i for t in have for rule, i in self.by_item.get(t, ()) if rule <= have]

    def match(self, items: Iterable[str]) -> bool:
        have = set(items)
        return any(rule <= have for t in have for rule, _ in self.by_item.get(t, ()))


def explicit_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The rule and verdict (a struct, or null) of {host + path: verdict}; a rule's host is what stands before its first slash."""
    by_labels: dict[int, dict[str, list[Column]]] = defaultdict(lambda: defaultdict(list))
    for rule, verdict in rules.items():
        at, _, start = rule.partition("/")
        values = {"long": len(rule), "host": len(at), "rule": rule, "verdict": verdict, "start": f"/{start}"}
        by_labels[at.count(".") + 1][at].append(F.struct(*(F.lit(v).alias(k) for k, v in values.items())))
    found = []
    for labels, hosts in by_labels.items():  # a host of fewer labels stays whole, and equals none of these
        listed = F.create_map(*(x for at, listed in hosts.items() for x in (F.lit(at), F.array(*listed))))
        found.append(F.filter(F.try_element_at(listed, F.substring_index(host, ".", -labels)), lambda r: F.startswith(path, r["start"])))
    if not found:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.array_max(F.flatten(F.array_compact(F.array(*found))))


def judge(pages: DataFrame, mined: Mined, explicit: dict[str, str], id_col: str = "page_id") -> DataFrame:
    """id, host, path, rule and verdict of every row."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), ascii_lower(F.regexp_extract(url, _URL, 2)).alias("host"), F.regexp_extract(url, _URL, 3).alias("path"), url.alias("url")
    )
    rows = rows.withColumn("found", explicit_rule(F.col("host"), F.col("path"), explicit))
    rows = rows.select("id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit("allow")).alias("verdict"), "url")
    if mined.rules:
        rules, item_of = [r for r, _, _ in mined.rules], mined.item_of
        asked = {i for r in rules for i in r}
        item_of = {t: i for t, i in item_of.items() if i in asked}

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = RuleIndex(rules)
            for batch in it:
                verdicts = batch.column(4).to_pylist()
                for i, (rule, address) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                    if rule is None and index.match({item_of[t] for t in url_tokens(address) if t in item_of}):
                        verdicts[i] = "block"
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(verdicts, pa.string())], names=batch.schema.names[:5])

        rows = in_batches(rows, batches, rows.drop("url").schema)
    return rows.drop("url").withColumnRenamed("id", id_col)


#: Explicit rules of the contract, host and path together.
EXPLICIT = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def document_number(url: str = "url") -> Column:
    """The document that a page shows: the number in its path, after the language."""
    return F.regexp_extract(url, r"://[^/?#]*/[a-z]+/([0-9]+)", 1).try_cast("long")


def filter_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; rules are mined from pages whose document has a label."""
    marked = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad")
    )
    shown = pages.select("url", document_number().alias("doc_id"))
    return judge(pages, mine(shown.join(marked, "doc_id").select("url", "bad")), EXPLICIT)


def explicit_verdicts(pages: DataFrame) -> DataFrame:
    """What the explicit rules alone say of every page: page_id, host, path, rule and verdict (allow where no rule fits)."""
    return judge(pages, Mined([], {}), EXPLICIT)


_FITS = "(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{start}')"
_BY_LENGTH = [(rule, *rule.split("/", 1)) for rule in sorted(EXPLICIT, key=lambda r: (-len(r), r))]
_CASE = "CASE " + " ".join(f"WHEN {_FITS.format(host=host, start=start)} THEN '{{{i}}}'" for i, (_, host, start) in enumerate(_BY_LENGTH)) + " END"
#: The explicit rules; what is mined is beyond SQL.
EXPLICIT_SQL = f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^(.*?)://([^/?#]*)([^?#]*)', 2), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^(.*?)://([^/?#]*)([^?#]*)', 3) AS path FROM pages)
SELECT page_id, host, path, {_CASE.format(*(rule for rule, _, _ in _BY_LENGTH))} AS rule,
       coalesce({_CASE.format(*(EXPLICIT[rule] for rule, _, _ in _BY_LENGTH))}, 'allow') AS verdict FROM u
"""
