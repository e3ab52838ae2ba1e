"""Main text of web pages: a suffix array over each host, guided by markup.

A page is read tag by tag into blocks; character references are decoded and white space in a block becomes one
space. The markup gives each block one of three kinds. ``OUT``: it stands in a menu, header, footer, sidebar, notice,
advert, form or reader comments, by element or by a class, id or role made of such words alone, or beside the
``article`` (else the ``main``) where the page has one. ``KEEP``: a prose element (paragraph, heading, list item,
quotation, ...) of the article. ``ASK``: any other block, as on pages without an article.

The token streams of all blocks of a host's pages, of whatever kind, are concatenated and sorted as suffixes
(prefix doubling to a depth of ``MIN_RUN`` tokens). A run of ``MIN_RUN`` tokens or more that stands on at least
``MIN_PAGES`` distinct pages and ``SHARE`` of the host's is repeated. Of ASK blocks, repeated runs within the block go, and
so do blocks that runs across their borders cover wholly; all else stays. KEEP blocks stay also where they are
repeated: articles quote, and copies of one article stand on many pages. ``n_repeated`` and ``n_removed`` give the page's
tokens in repeated runs, and those of them that went from its text. Pages with equal streams count as one page.

Blocks are parsed once and shuffled once, by host. A host of more than ``PART_BYTES`` is dealt by page into parts of
``PART_PAGES`` pages or more, so a host with a third of all pages is never in one task. Its repeated runs are those of the
whole host all the same, and no result depends on the parts: equal streams that count go to one part (a task's further copies
to any, uncounted), so the parts' numbers of distinct pages add up. A run with the host's share has that share in
some part, so each part names the runs that have it there (``part_runs``); those whose sum over the host can suffice are
counted in all its parts (``run_counts``), and those that do suffice come back to all parts. No run is
capped or hashed; copies within a task are known by 128-bit digests of their streams.

Parsing takes time in proportion to the page, however malformed: no pattern goes back over what it has read, and the
stack of open elements is never searched.

Defined results: a null or empty html has empty text; pages with a null url, or one without ``://``, are one host;
repeated rows stay, each with its text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import in_batches, materialise, release_memory

MIN_RUN = 8
#: Boilerplate stands on most pages of a host; what fewer share may be main text.
MIN_PAGES = 3
SHARE = 0.25
PART_BYTES = 1_000_000
PART_PAGES = 20
#: About so many parts of full size make a task.
TASK_PARTS = 8
BROADCAST_HOSTS = 100_000
#: A task remembers so many streams of hosts in parts, to know copies.
SEEN = 100_000
OUT, ASK, KEEP = 0, 1, 2

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*+>.*?(?:</\1\s*+>|\Z)
      |<(/?)([a-zA-Z][^\s/>"'<]*+)(?:((?:[^'"<>]++|"[^"]*+"|'[^']*+')*+)>|([^<>]*+)>)|<[!?/][^>]*+(?:>|\Z)|[^<]++|<""",
    re.VERBOSE | re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption caption".split())
BLOCKS = PROSE | frozenset(
    "html body div section article main ul ol dl table thead tbody tfoot tr figure hr br address details summary "
    "header footer nav aside form fieldset center".split()
)
HIDDEN = frozenset("head title script style noscript template iframe object svg canvas select textarea audio video".split())
LEFT_OUT = frozenset("nav header footer aside form button dialog menu".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored".split())
COMMENTS = frozenset("comment comments disqus replies".split())
LEFT_OUT_NAMES = (
    ADVERTS
    | COMMENTS
    | frozenset(
        "promo promotion banner cookie cookies consent notice notices alert newsletter subscribe signup sidebar menu nav navbar "
        "navigation breadcrumb breadcrumbs footer header masthead share sharing social related popup modal pagination "
        "pager toolbar contentinfo complementary search form".split()
    )
)
#: Words that change nothing in a name: "comment-list" is a name of comments, "share-price" none of sharing.
NEUTRAL = frozenset(
    "list box block bar wrapper container section area item items inner outer widget button buttons link links top bottom left "
    "right main site page global primary secondary".split()
)
#: What an opening block ends, if nothing but inline elements stands between: an open paragraph, and these.
_P = frozenset({"p"})
_CLOSES = {
    "li": _P | {"li"},
    "dt": _P | {"dt", "dd"},
    "dd": _P | {"dt", "dd"},
    "tr": _P | {"tr", "td", "th"},
    "td": _P | {"td", "th"},
    "th": _P | {"td", "th"},
}


def _named(tag: str, attributes: str) -> bool:
    """Whether a class, id or role says that the element is no main text."""
    if tag in ("html", "body", "main"):
        return False
    names = ADVERTS if tag in PROSE else ADVERTS | COMMENTS if tag == "article" else LEFT_OUT_NAMES
    for _, *values in _ATTRIBUTE.findall(attributes):
        for name in "".join(values).lower().split():
            words = _WORD.findall(name)
            if not names.isdisjoint(words) and all(w in names or w in NEUTRAL or w.isdigit() for w in words):
                return True
    return False


def parse(page: str) -> list[tuple[str, int]]:
    """(text, kind) of all blocks of text, in page order."""
    found: list[tuple[str, str | None, bool]] = []  # text, container (None: left out), in prose
    stack: list[tuple[str, int, int, int]] = []  # tag, and what it adds to hidden, skipped and forms
    blocks: list[int] = []  # where block elements stand in the stack
    open_tags: Counter[str] = Counter()
    hidden = skipped = forms = prose = 0
    words: list[str] = []
    others: list[str] = []

    def close_block() -> None:
        for held, out in ((words, False), (others, True)):
            if held:
                text = " ".join(html.unescape("".join(held)).split())
                held.clear()
                if text:
                    inside = "article" if open_tags["article"] else "main" if open_tags["main"] else "body"
                    found.append((text, None if out else inside, prose > 0))

    def pop() -> None:
        nonlocal hidden, skipped, forms, prose
        tag, a, b, c = stack.pop()
        hidden, skipped, forms, prose = hidden - a, skipped - b, forms - c, prose - (tag in PROSE)
        open_tags[tag] -= 1
        if blocks and blocks[-1] == len(stack):
            blocks.pop()

    for token in _TOKEN.finditer(page):
        tag = token[3]
        if tag is None:
            if hidden == 0 and (token[0][0] != "<" or token[0] == "<"):
                (others if skipped else words).append(token[0])
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            close_block()
        if token[2]:
            if open_tags[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS and blocks and stack[blocks[-1]][0] in _CLOSES.get(tag, _P):
            depth = blocks[-1]  # an open paragraph ends where a block begins, as browsers have it
            while len(stack) > depth:
                pop()
        attributes = token[4] or token[5]
        out = tag in LEFT_OUT or bool(attributes) and "=" in attributes and _named(tag, attributes)
        b, c = int(out), int(tag == "form")
        if tag in ("article", "main") and not out and 0 < skipped == forms:  # some sites put all of a page into a form
            b, c = -skipped, -forms
        stack.append((tag, int(tag in HIDDEN), b, c))
        hidden, skipped, forms, prose = hidden + (tag in HIDDEN), skipped + b, forms + c, prose + (tag in PROSE)
        open_tags[tag] += 1
        if tag in BLOCKS:
            blocks.append(len(stack) - 1)
    close_block()
    kinds = {kind for _, kind, _ in found}
    best = "article" if "article" in kinds else "main" if "main" in kinds else "body"
    return [(text, OUT if kind != best else KEEP if inside and best != "body" else ASK) for text, kind, inside in found]


def _runs(whole: np.ndarray, owner: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``depth`` tokens begin, and their numbers: equal runs have equal ones.

    Suffixes are ranked by their first 1, 2, 4, ... tokens up to ``depth``; those that have equal ranks then share that
    prefix. No run reaches beyond its page.
    """
    if whole.size < depth:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left = _left(owner)
    _, rank = np.unique(whole, return_inverse=True)
    length = 1
    while length < depth:
        step = min(length, depth - length)
        nxt = np.zeros_like(rank)
        nxt[:-step] = rank[step:] + 1
        nxt[left <= step] = 0
        _, rank = np.unique(rank * (rank.max() + 2) + nxt, return_inverse=True)
        length += step
    at = np.flatnonzero(left >= depth)
    return at, np.unique(rank[at], return_inverse=True)[1]


def _left(owner: np.ndarray) -> np.ndarray:
    """How many tokens there are from each up to the end of its page."""
    return np.cumsum(np.bincount(owner))[owner] - np.arange(owner.size)


def _pages_on(run_of: np.ndarray, pages_of: np.ndarray, runs: int = 0) -> np.ndarray:
    """On how many different pages each run stands."""
    pages = pages_of.max(initial=0) + 1
    return np.bincount(np.unique(run_of * pages + pages_of) // pages, minlength=runs)


def repeated_starts(whole: np.ndarray, owner: np.ndarray, distinct: np.ndarray, depth: int, least: int) -> np.ndarray:
    """Where runs of ``depth`` tokens begin that ``least`` distinct pages have.

    ``whole`` has the pages' tokens one after another and ``owner`` their pages, from 0 on; ``distinct`` gives each page's
    number among different streams.
    """
    at, run_of = _runs(whole, owner, depth)
    return at[_pages_on(run_of, distinct[owner[at]])[run_of] >= least]


def given_starts(whole: np.ndarray, owner: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the given runs (different rows of tokens) begin, and which; token by token down their prefixes."""
    at = np.flatnonzero(_left(owner) >= given.shape[1])
    base = max(whole.max(initial=0), given.max(initial=0)) + 1
    state, prefix = np.zeros(at.size, np.int64), np.zeros(given.shape[0], np.int64)
    for k in range(given.shape[1]):
        keys, prefix = np.unique(prefix * base + given[:, k], return_inverse=True)
        mine = state * base + whole[at + k]
        state = np.minimum(np.searchsorted(keys, mine), keys.size - 1)
        hit = keys[state] == mine
        at, state = at[hit], state[hit]
    which = np.empty(given.shape[0], np.int64)
    which[prefix] = np.arange(given.shape[0])
    return at, which[state]


def _spread(starts: np.ndarray, depth: int, size: int) -> np.ndarray:
    """Which of ``size`` positions the runs cover."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + depth, -1)
    return np.cumsum(change[:-1]) > 0


def _coded(texts: list[str], runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The texts' tokens one after another and how many each has, the runs' as rows, and the tokens by number."""
    lists = pc.split_pattern(pa.array(texts + runs, pa.large_string()), " ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)[: len(texts)]
    tokens = lists.flatten().dictionary_encode()
    codes, n = tokens.indices.to_numpy().astype(np.int64), sizes.sum()
    return codes[:n], sizes, codes[n:].reshape(-1, MIN_RUN), tokens.dictionary


def _different(pages: list[list[str]]) -> list[str]:
    """The different streams of tokens among the pages' blocks; pages without a token have none."""
    return list(dict.fromkeys(" ".join(texts) for texts in pages if texts))


def part_runs(pages: list[list[str]]) -> tuple[int, list[tuple[str, int]]]:
    """How many different pages a part has, and its runs with the share of these, with how many more than just short of it."""
    streams = _different(pages)
    if not streams:
        return 0, []
    whole, sizes, _, tokens = _coded(streams, [])
    owner = np.repeat(np.arange(len(streams)), sizes)
    at, run_of = _runs(whole, owner, MIN_RUN)
    more = _pages_on(run_of, owner[at]) - _short(len(streams))
    _, first = np.unique(run_of, return_index=True)
    named = np.flatnonzero(more > 0)
    words = tokens.take(pa.array(whole[at[first[named]][:, None] + np.arange(MIN_RUN)].ravel())).to_pylist()
    return len(streams), [(" ".join(words[i * MIN_RUN : (i + 1) * MIN_RUN]), n) for i, n in enumerate(more[named].tolist())]


def _short(pages: int) -> int:
    """The most of a part's pages that are short of the share."""
    return max(0, math.ceil(SHARE * pages) - 1)


def run_counts(pages: list[list[str]], runs: list[str]) -> list[int]:
    """On how many different pages each of the runs stands."""
    streams = _different(pages)
    if not streams or not runs:
        return [0] * len(runs)
    whole, sizes, given, _ = _coded(streams, runs)
    owner = np.repeat(np.arange(len(streams)), sizes)
    at, which = given_starts(whole, owner, given)
    return _pages_on(which, owner[at], len(runs)).tolist()


def host_texts(pages: list[list[tuple[str, int]]], runs: list[str] | None = None) -> list[tuple[str, int, int]]:
    """Text, n_repeated and n_removed of each page from its blocks; of a whole host, or of any pages of one with its repeated runs."""
    blocks = [b for page in pages for b in page]
    if not blocks:
        return [("", 0, 0)] * len(pages)
    if runs is not None and not runs:
        return [("\n".join(t for t, k in page if k != OUT), 0, 0) for page in pages]
    whole, sizes, given, _ = _coded([t for t, _ in blocks], runs or [])
    kinds = np.array([k for _, k in blocks])
    block_of = np.repeat(np.arange(len(blocks)), sizes)
    page_of_block = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    _, owner = np.unique(page_of_block[block_of], return_inverse=True)  # pages without a token are no pages here
    if runs is None:
        ends = np.cumsum(np.bincount(owner))
        streams = [whole[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]
        numbers: dict[bytes, int] = {}
        distinct = np.array([numbers.setdefault(s, len(numbers)) for s in streams])
        starts = repeated_starts(whole, owner, distinct, MIN_RUN, max(MIN_PAGES, math.ceil(SHARE * len(numbers))))
    else:
        starts, _ = given_starts(whole, owner, given)
    covered = _spread(starts, MIN_RUN, whole.size)
    within = _spread(starts[block_of[starts] == block_of[starts + MIN_RUN - 1]], MIN_RUN, whole.size)
    n_covered = np.bincount(block_of, covered, minlength=len(blocks)).astype(np.int64)
    gone = (kinds == ASK)[block_of] & (within | (n_covered == sizes)[block_of])
    n_gone = np.bincount(block_of, gone, minlength=len(blocks)).astype(np.int64)
    first, out, at = np.cumsum(sizes) - sizes, [], 0
    for page in pages:
        texts = []
        for i, (text, kind) in enumerate(page, at):
            if kind != OUT and n_gone[i]:
                text = " ".join(t for t, g in zip(text.split(" "), gone[first[i] : first[i] + sizes[i]].tolist(), strict=True) if not g)
            if kind != OUT and text:
                texts.append(text)
        mine = slice(at, at + len(page))
        out.append(("\n".join(texts), int(n_covered[mine].sum()), int(n_gone[mine].sum())))
        at += len(page)
    return out


_BLOCKS = "rid long, host string, part int, parts int, counts boolean, texts array<string>, kinds binary"


def _parsed(pages: DataFrame, part_bytes: int) -> tuple[DataFrame, int, bool]:
    """Each page with its host, its part of the host, whether it counts there, and its blocks; how many tasks' worth of
    parts there are; and whether any host is in parts."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bytes]] = set()

        def place(rid: int, host: str, parts: int, blocks: list[tuple[str, int]]) -> tuple[int, bool]:
            if parts == 1:
                return 0, True
            digest = hashlib.blake2b(" ".join(t for t, _ in blocks).encode(), digest_size=16).digest()
            if not blocks or (host, digest) in seen:
                return rid % parts, False
            if len(seen) >= SEEN:
                seen.clear()
            seen.add((host, digest))
            return int.from_bytes(digest) % parts, True

        for batch in it:
            blocks = [parse(page or "") for page in batch.column(5).to_pylist()]
            places = list(map(place, *(batch.column(i).to_pylist() for i in (2, 3, 4)), blocks))
            texts = pa.array([[t for t, _ in b] for b in blocks], pa.list_(pa.string()))
            kinds = pa.array([bytes(k for _, k in b) for b in blocks], pa.binary())
            dealt = [pa.array([p for p, _ in places], pa.int32()), batch.column(4), pa.array([c for _, c in places], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *dealt, texts, kinds], names=schema.names)
        release_memory()

    url, page = F.col("url").cast("string"), F.col("html").cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))
    picked = pages.select("page_id", "url", F.monotonically_increasing_id().alias("rid"), host.alias("host"), page.alias("html"))
    sizes = pages.select(host.alias("host"), F.octet_length(page).alias("n")).groupBy("host").agg(F.sum("n").alias("n"), F.count("*").alias("pages"))
    sizes = materialise(sizes, "hosts")
    tasks = math.ceil((sizes.agg(F.sum("n")).first()[0] or 0) / (TASK_PARTS * part_bytes))
    parts = F.least(F.ceil(F.col("n") / part_bytes), F.ceil(F.col("pages") / PART_PAGES)).cast("int")
    large = sizes.select("host", parts.alias("parts")).where("parts > 1")
    n_large = large.count()
    large = F.broadcast(large) if n_large <= BROADCAST_HOSTS else large
    dealt = picked.join(large, "host", "left").select("page_id", "url", "rid", "host", F.coalesce("parts", F.lit(1)).alias("parts"), "html")
    schema = T.StructType([picked.schema["page_id"], picked.schema["url"], *T._parse_datatype_string(_BLOCKS).fields])
    return in_batches(dealt, batches, schema), tasks, n_large > 0


def _by_part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One batch for each part of a host, from rows in their order."""

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    now, held = None, []
    for batch in it:
        keys = list(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if keys[start] != now and held:
                    yield whole(held)
                    held = []
                now = keys[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield whole(held)


_RUNS = "host string, part int, lead long, least long, run string, n long, short long"


def _host_runs(dealt: DataFrame) -> DataFrame:
    """host, part, lead (the part's first rid) and runs: the host's repeated runs, for each part of hosts that are in parts.

    Hosts without repeated runs are left out.
    """

    def rows_of(rows: pa.RecordBatch, least: int | None, runs: list[tuple[str | None, int, int]]) -> pa.RecordBatch:
        """A row for each run, and one without a run for the part."""
        n, rid = len(runs), pc.min(rows.column(2)).as_py()
        columns = [[rows.column(3)[0].as_py()] * n, [rows.column(4)[0].as_py()] * n, [rid] * n, [least] * n, *zip(*runs, strict=True)]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def in_parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_part(b for b in (batch.filter(pc.greater(batch.column(5), 1)) for batch in it) if b.num_rows)

    def counting(rows: pa.RecordBatch) -> list[list[str]]:
        return rows.column(7).filter(rows.column(6)).to_pylist()

    def named(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_parts(it):
            n, runs = part_runs(counting(rows))
            yield rows_of(rows, None, [(None, n, _short(n)), *((run, more, 0) for run, more in runs)])
        release_memory()

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_parts(it):
            runs, least = rows.column(9).drop_null(), rows.column(10).drop_null()
            if len(runs):
                wanted = runs[0].as_py()
                found = zip(wanted, run_counts(counting(rows), wanted), strict=True)
                yield rows_of(rows, least[0].as_py(), [(None, 0, 0), *((run, n, 0) for run, n in found if n)])
        release_memory()

    def to_parts(rows: DataFrame) -> DataFrame:
        """For each part of a host, all runs of the host that are in ``rows``."""
        by_host = rows.groupBy("host").agg(F.collect_list("run").alias("runs"), F.flatten(F.collect_list("parts")).alias("parts"), F.max("least").alias("least"))
        return by_host.where(F.size("runs") > 0).select("host", "runs", "least", F.explode("parts").alias("p")).select("host", "p.part", "p.lead", "runs", "least")

    def summed(rows: DataFrame) -> DataFrame:
        part = F.when(F.col("run").isNull(), F.struct("part", "lead"))
        sums = [F.sum("n").alias("n"), F.sum("short").alias("short"), F.max("least").alias("least"), F.collect_list(part).alias("parts")]
        return rows.groupBy("host", "run").agg(*sums)

    names = T._parse_datatype_string(_RUNS).names
    host, no_run = Window.partitionBy("host"), F.col("run").isNull()
    some = summed(in_batches(dealt.sortWithinPartitions("host", "part"), named, _RUNS))
    pages, short = F.sum(F.when(no_run, F.col("n"))).over(host), F.sum("short").over(host)
    some = some.withColumn("least", F.greatest(F.lit(MIN_PAGES), F.ceil(F.lit(SHARE) * pages)).cast("long")).withColumn("short", short)
    some = to_parts(some.where(no_run | (F.col("n") + F.col("short") >= F.col("least"))))
    exact = summed(in_batches(_with_runs(dealt, some), counted, _RUNS))
    return to_parts(exact.where(no_run | (F.col("n") >= F.col("least"))))


def _with_runs(dealt: DataFrame, runs: DataFrame) -> DataFrame:
    """``dealt`` in the order of parts, with a part's runs at one of its rows.

    All columns of ``dealt`` are kept wherever it is used, so that Spark makes its shuffle once.
    """
    runs = runs.select(F.col("host").alias("h"), F.col("part").alias("p"), "lead", "runs", "least").hint("merge")
    at = (F.col("host") == F.col("h")) & (F.col("part") == F.col("p")) & (F.col("rid") <= F.col("lead"))
    return dealt.join(runs, at, "left").drop("h", "p", "lead").sortWithinPartitions("host", "part")


def extract(pages: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated and n_removed of every page."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(it):
            runs = None
            if rows.column(5)[0].as_py() > 1:
                given = rows.column(9).drop_null()
                runs = given[0].as_py() if len(given) else []
            pages_of = [list(zip(t, k, strict=True)) for t, k in zip(rows.column(7).to_pylist(), rows.column(8).to_pylist(), strict=True)]
            made = host_texts(pages_of, runs)
            texts = [t for t, _, _ in made]
            columns = [pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in (list(map(len, texts)), [r for _, r, _ in made], [g for _, _, g in made]))]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *columns], names=schema.names)
        release_memory()

    parsed, tasks, in_parts = _parsed(pages, part_bytes)
    tasks = max(tasks, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = parsed.repartition(tasks, "host", "part")
    dealt = _with_runs(dealt, _host_runs(dealt)) if in_parts else dealt.sortWithinPartitions("host", "part")
    more = "text string, n_chars long, n_repeated long, n_removed long"
    schema = T.StructType([parsed.schema["page_id"], parsed.schema["url"], *T._parse_datatype_string(more).fields])
    return in_batches(dealt, batches, schema)
