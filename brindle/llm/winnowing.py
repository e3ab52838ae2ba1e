"""Benchmark decontamination by winnowing, in DataFrame and SQL functions only.

Document and item words are cut into 5-word grams; of every 6 consecutive gram hashes the smallest is
kept as a fingerprint, so any shared span of 5 + 6 - 1 = 10 words shares a kept fingerprint. Every
fingerprint carries the words around it (5 to the left, 10 from its start on): enough to hold every
10-word window that contains the gram. Document and item fingerprints are joined on the hash; a hit
is extended word by word in both directions and counts if the matching run has 10 words or more.
An item of fewer than 10 words is one window: for each such length n that occurs, grams are n words
and the winnowing window is one gram, which keeps every gram.

The join side of the benchmark has one row for each distinct context, whatever number of items share it; which items those
are is a table of its own that is joined after the hits are verified. If the contexts' measured bytes are few
(``broadcast_bytes``), they are broadcast, and fingerprints never leave their row's task before the join. Beyond that
the join is shuffled: first hashes and positions alone meet the benchmark's distinct hashes (the documents being written
before, so that their rows keep their numbers), then only fingerprints that met some get their words. Each document has
a marker row of its own key in the join, so documents without a hit stay without a key that all have.

Defined results: a null text (or item text) has no words; a null or repeated ``item_id`` counts once
in ``n_items`` as far as it is not null; repeated documents give repeated rows; an empty document
table gives an empty result and an empty benchmark leaves every document clean. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import ascii_lower, materialise, numbered, without

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 10
GRAM = 5
WINNOW = SPAN - GRAM + 1
LEAD = SPAN - GRAM
BROADCAST_BYTES = 32_000_000


def words(text: str = "text") -> Column:
    """Every match of ``WORD``, got by splitting at what lies between (ten times as fast as extracting)."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), BETWEEN, -1), "")


#: The smallest gram hash of each window, with its position: 36 bits of the hash stand above 28 bits of
#: position (an array holds no more words), so that the minimum of a window is one comparison of longs.
#: Documents and items order grams alike, as the guarantee needs; hits are compared word by word.
POSITION_BITS = 28
MASK = f"{(1 << POSITION_BITS) - 1}L"
_WORD_HASHES = "transform(w, x -> xxhash64(x))"
_GRAMS = f"""slice(transform(h, (x, i) -> shiftleft(
    xxhash64({', '.join(['x', *(f'get(h, i + {k})' for k in range(1, GRAM))])}), {POSITION_BITS}) | cast(i AS BIGINT)),
    1, size(h) - {GRAM - 1})"""
_KEPT = f"""array_distinct(slice(
    transform(g, (x, i) -> least({', '.join(['x', *(f'get(g, i + {k})' for k in range(1, WINNOW))])})),
    1, size(g) - {WINNOW - 1}))"""
_FINGERPRINTS = f"""transform(kept, x -> named_struct(
    'kind', {SPAN},
    'hash', shiftright(x, {POSITION_BITS}),
    'pos', cast(x & {MASK} AS INT),
    'lead', least(cast(x & {MASK} AS INT), {LEAD}),
    'ctx', slice(w, greatest(cast(x & {MASK} AS INT) - {LEAD}, 0) + 1,
                 least(cast(x & {MASK} AS INT), {LEAD}) + {SPAN})))"""
_NONE = "array<struct<kind:int,hash:bigint,pos:int,lead:int,ctx:array<string>>>"


def _short(n: int) -> str:
    """All grams of ``n`` words, for items that have just ``n``."""
    return f"""transform(sequence(0, size(w) - {n}), i -> named_struct(
        'kind', {n}, 'hash', xxhash64(slice(w, i + 1, {n})), 'pos', i, 'lead', 0, 'ctx', slice(w, i + 1, {n})))"""


def _with_fingerprints(rows: DataFrame, lengths: list[int], only_own_kind: bool) -> DataFrame:
    """Adds ``fps`` to rows with the word array ``w``. Items have grams of their own kind only."""
    rows = rows.withColumn("h", F.expr(f"IF(size(w) >= {SPAN}, {_WORD_HASHES}, CAST(NULL AS array<bigint>))"))
    rows = rows.withColumn("g", F.expr(f"IF(size(w) >= {SPAN}, {_GRAMS}, CAST(NULL AS array<bigint>))"))
    rows = rows.withColumn("kept", F.expr(f"IF(size(w) >= {SPAN}, {_KEPT}, CAST(NULL AS array<bigint>))"))
    parts = [f"IF(size(w) >= {SPAN}, {_FINGERPRINTS}, CAST(array() AS {_NONE}))"]
    for n in lengths:
        fits = f"size(w) = {n}" if only_own_kind else f"size(w) >= {n}"
        parts.append(f"IF({fits}, {_short(n)}, CAST(array() AS {_NONE}))")
    return rows.withColumn("fps", F.expr(f"concat({', '.join(parts)})")).drop("h", "g", "kept")


def benchmark_contexts(items: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """One row per distinct fingerprint context of the items, the items of each context, and the lengths of short items."""
    rows = items.select("item_id", words().alias("w"))
    short = rows.select(F.size("w").alias("n")).where(f"n BETWEEN 1 AND {SPAN - 1}").distinct()
    lengths = sorted(r.n for r in short.collect())  # nine values at most
    fps = _with_fingerprints(rows, lengths, True).select("item_id", F.explode_outer("fps").alias("f")).where("f IS NOT NULL")
    named = [F.xxhash64(F.lit(k), "f.kind", "f.lead", "f.ctx").alias(f"c{k}") for k in range(2)]  # 128 bits name a context
    fps = materialise(fps.select("item_id", "f.kind", "f.hash", F.col("f.lead").alias("ilead"), F.col("f.ctx").alias("ictx"), *named), "benchmark")
    contexts = fps.drop("item_id").dropDuplicates(["kind", "hash", "c0", "c1"])
    items_of = fps.where("item_id IS NOT NULL").select("c0", "c1", F.col("item_id").cast("string").alias("item")).distinct()
    return materialise(contexts, "benchmark-contexts"), materialise(items_of, "benchmark-items"), lengths


def _run(direction: int) -> Column:
    """How many words next to the shared gram agree, going left (-1) or right (+1)."""
    most = SPAN - GRAM
    first = -1 if direction < 0 else GRAM
    run = F.lit(most)
    for d in reversed(range(most)):
        step = first + direction * d
        here, there = F.get("ctx", F.col("lead") + step), F.get("ictx", F.col("ilead") + step)
        run = F.when(~F.coalesce(here == there, F.lit(False)), d).otherwise(run)
    return run


def _broadcast_if_small(table: DataFrame, size: Column, most: int) -> tuple[DataFrame, bool]:
    """The table, marked for broadcasting if its rows, of ``size`` bytes each and some overhead, are small."""
    small = (table.agg(F.sum(size + 64)).first()[0] or 0) <= most
    return (F.broadcast(table) if small else table), small


#: The words around fingerprints of which only kind, hash and position are known.
_AROUND = f"""transform(met, x -> named_struct('kind', x.kind, 'hash', x.hash, 'pos', x.pos,
    'lead', IF(x.kind = {SPAN}, least(x.pos, {LEAD}), 0),
    'ctx', IF(x.kind = {SPAN}, slice(w, greatest(x.pos - {LEAD}, 0) + 1, least(x.pos, {LEAD}) + {SPAN}), slice(w, x.pos + 1, x.kind))))"""


def _met_fingerprints(rows: DataFrame, contexts: DataFrame, lengths: list[int]) -> DataFrame:
    """``rows`` (written before) with ``fps``: those whose hash the benchmark has, found by a shuffled join."""
    slim = F.transform("fps", lambda f: F.struct(f["kind"].alias("kind"), f["hash"].alias("hash"), f["pos"].alias("pos")))
    each = _with_fingerprints(rows, lengths, False).select("rid", F.explode_outer(slim).alias("f")).where("f IS NOT NULL").select("rid", "f.*")
    met = each.join(contexts.select("kind", "hash").distinct(), ["kind", "hash"], "left_semi")
    met = met.groupBy("rid").agg(F.collect_list(F.struct("kind", "hash", "pos")).alias("met"))
    return rows.join(met, "rid", "left").withColumn("fps", F.expr(f"coalesce({_AROUND}, CAST(array() AS {_NONE}))")).drop("met")


def contaminated_spans(
    docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id"
) -> DataFrame:
    """Per row of ``docs``: ``id_col`` (as doc_id), rid, n_words, spans (array of first/last hit word) and item_ids (string, sorted).

    ``rid`` tells repeated rows apart.
    """
    contexts, items_of, lengths = benchmark_contexts(items)
    contexts, small = _broadcast_if_small(contexts, F.octet_length(F.array_join("ictx", " ")), broadcast_bytes)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col("text").cast("string").alias("text"))
    if small:
        made = _with_fingerprints(texts.select("doc_id", "rid", words().alias("w")), lengths, False)
    else:
        made = _met_fingerprints(materialise(texts, "texts").select("doc_id", "rid", words().alias("w")), contexts, lengths)
    own = "named_struct('kind', -1, 'hash', rid, 'pos', -1, 'lead', 0, 'ctx', CAST(array() AS array<string>))"
    # explode_outer: explode would infer a filter on its array, which is pushed down and inlines all that makes it;
    # the word array ends before the explode, which would copy it for every fingerprint
    grams = made.select("doc_id", "rid", F.size("w").cast("long").alias("n_words"), F.expr(f"concat(array({own}), fps)").alias("fps")).select(
        "doc_id", "rid", "n_words", F.explode_outer("fps").alias("f")
    )
    met = grams.select("doc_id", "rid", "n_words", "f.*").join(contexts, ["kind", "hash"], "left")
    met = met.where("kind = -1 OR ictx IS NOT NULL").withColumns({"left": _run(-1), "right": _run(+1)})
    same = F.slice("ctx", F.col("lead") + 1, GRAM) == F.slice("ictx", F.col("ilead") + 1, GRAM)
    whole = F.when(F.col("kind") == SPAN, same & (F.col("left") + F.col("right") + GRAM >= SPAN)).otherwise(
        F.col("ctx") == F.col("ictx")
    )
    hit = (F.col("kind") > 0) & whole
    long = F.col("kind") == SPAN
    span = F.struct(
        F.when(long, F.col("pos") - F.col("left")).otherwise(F.col("pos")).alias("first"),
        F.when(long, F.col("pos") + GRAM - 1 + F.col("right")).otherwise(F.col("pos") + F.col("kind") - 1).alias("last"),
    )
    found = met.select("doc_id", "rid", "n_words", F.when(hit, span).alias("span"), F.when(hit, F.struct("c0", "c1")).alias("c"))
    found = found.groupBy("rid", "doc_id", "n_words").agg(F.collect_set("span").alias("spans"), F.collect_set("c").alias("contexts"))
    found = materialise(found, "hits")
    items_of, _ = _broadcast_if_small(items_of, F.octet_length("item"), broadcast_bytes)
    named = found.select("rid", F.inline("contexts")).join(items_of, ["c0", "c1"]).groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    return found.drop("contexts").join(named, "rid", "left").withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))


#: Words that the spans cover: their starts are sorted, and each adds what reaches beyond those before.
_COVERED = """aggregate(array_sort(spans), named_struct('n', 0L, 'end', -1),
    (s, x) -> named_struct('n', s.n + greatest(0, x.last - greatest(s.end, x.first - 1)), 'end', greatest(s.end, x.last)),
    s -> s.n)"""


def decontaminate(docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    return contaminated_spans(docs, items, broadcast_bytes).select(
        "doc_id",
        "n_words",
        F.expr(_COVERED).cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the rows that share a window with an item."""
    rows = numbered(docs)
    found = contaminated_spans(rows.select("rid", "row.text"), items, broadcast_bytes, "rid")
    return without(rows, found.where(F.size("spans") > 0).select(F.col("doc_id").alias("rid")))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {SPAN}) AS k,
              unnest(list_transform(range(0, greatest(0, len(w) - least(len(w), {SPAN})) + 1),
                     lambda i: array_to_string(w[i + 1:i + least(len(w), {SPAN})], ' '))) AS g
       FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, k, unnest(range(0, len(w) - k + 1)) AS i, w FROM d, ks WHERE len(w) >= k),
hits AS (SELECT dw.rid, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON bw.k = dw.k AND bw.g = array_to_string(dw.w[i + 1:i + dw.k], ' ')),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256,
       coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""
