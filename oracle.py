"""DuckDB SQL for the registered queries, composed from shared common table expressions.

Order-dependent folds are recursive CTEs that carry a list of loads.
"""

from __future__ import annotations

# Fixed parameters of the registered queries.
# The tables do not fill whole periods of S * M rows, so the last one is incomplete.
S, K, M, THETA, EPS, FACTOR, LEARN, DKG_THETA = 4, 8, 130, 0.02, 0.01, 2.0, 2000, 0.009
# Rows that a discarding strategy leaves out besides the learned ones; many short periods.
SKIP, SHORT_M, SHORT_THETA = 2, 25, 0.1
# Too few counters for the keys of a window.
COUNTERS, WORD_COUNTERS = 20, 400
# Configuration of the word stream.
WS, WK, WM, WTHETA = 4, 32, 1000, 0.01
# Two-choice with a key far above 2/k of the rows, over many chunks.
HOT_K, HOT_KEY, HOT_CHUNK = 32, 7, 200
P = 10000019
AB = ((3141593, 2718282), (5772157, 1618034))
BUCKETS = 16
MURMUR, MURMUR_PRIMES = 13, (31, 37)
ZIPF_N, ZIPF_Z, ZIPF_SEED, ZIPF_WIDE = 1000, 1.0, 1000, 1_000_000_000


def h(x: str, k: int, member: int = 0) -> str:
    a, b = AB[member]
    return f"CAST((({a} * (({x}) % {P}) + {b}) % {P}) % {k} AS INTEGER)"


def murmur(base: str, k: int, seed: int) -> str:
    """CTEs ``mm0`` to ``mm3``: Murmur3-x86-32 of ``seed`` (4 bytes, itself seeded with 42), then of ``key`` (8 bytes)."""
    # Fixed values of Murmur3.
    c1, c2, add, f1, f2 = 3432918353, 461845907, 3864292196, 2246822507, 3266489909
    low = "4294967295::UBIGINT"
    times = lambda x, c: f"(({x}) * {c}::UBIGINT) & {low}"
    turn = lambda x, r: f"((({x}) << {r}) | (({x}) >> {32 - r})) & {low}"

    def step(fields: list[tuple[str, str]]) -> str:
        """Fields one after another, each built from those before it."""
        out = "SELECT * FROM src"
        for name, value in fields:
            out = f"SELECT * EXCLUDE ({name}), {value} AS {name} FROM ({out})"
        return out

    def mixed(block: str) -> list[tuple[str, str]]:
        return [
            ("x", times(block, c1)), ("x", turn("x", 15)), ("x", times("x", c2)),
            ("hash", "xor(hash, x)"), ("hash", turn("hash", 13)), ("hash", f"(hash * 5::UBIGINT + {add}::UBIGINT) & {low}"),
        ]

    def ended(n: int) -> list[tuple[str, str]]:
        return [
            ("hash", f"xor(hash, {n}::UBIGINT)"), ("hash", "xor(hash, hash >> 16)"), ("hash", times("hash", f1)),
            ("hash", "xor(hash, hash >> 13)"), ("hash", times("hash", f2)), ("hash", "xor(hash, hash >> 16)"),
        ]

    fields = [*mixed(f"{seed}::UBIGINT"), *ended(4), *mixed("lo"), *mixed("hi"), *ended(8)]
    words = "CAST(key & 4294967295 AS UBIGINT) AS lo, CAST((key >> 32) & 4294967295 AS UBIGINT) AS hi"
    signed = "CASE WHEN hash >= 2147483648 THEN CAST(hash AS BIGINT) - 4294967296 ELSE CAST(hash AS BIGINT) END"
    return (
        f"WITH src AS (SELECT seq, {words}, 42::UBIGINT AS hash, 0::UBIGINT AS x FROM ({base}) AS b) "
        f"SELECT seq, CAST((({signed}) % {k} + {k}) % {k} AS INTEGER) AS worker FROM ({step(fields)})"
    )


def fold_md5(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"


def hs(x: str, k: int, member: int = 0) -> str:
    """Hash of a word by its CRC-32, looked up in ``crc``."""
    return h(f"(SELECT crc.crc FROM crc WHERE crc.word = {x})", k, member)


# CRC-32 (reflected, polynomial 0xEDB88320) of every distinct word, by the usual byte table.
CRC = """
crct AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS tab
  FROM (SELECT CAST(i AS BIGINT) AS i FROM range(256) AS r(i))),
crcb AS (SELECT word, list_transform(range(len(x) // 2),
    lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)) AS bytes
  FROM (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT key AS word FROM ev))),
crc AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
    lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c // 256)), 4294967295) AS crc FROM crcb, crct)"""


EV = "ev AS (SELECT event_id AS seq, user_id AS key FROM events)"

HOT_EV = f"ev AS (SELECT event_id AS seq, CASE WHEN event_id % 10 < 3 THEN {HOT_KEY} ELSE user_id END AS key FROM events)"

WORDS = r"""
docw AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS l FROM documents),
docn AS (SELECT doc_id, l, CAST(sum(len(l)) OVER (ORDER BY doc_id) - len(l) AS BIGINT) AS first FROM docw),
ev AS (SELECT first + pos - 1 AS seq, l[pos] AS key, doc_id, pos - 1 AS pos
       FROM (SELECT first, l, doc_id, unnest(generate_series(1, len(l))) AS pos FROM docn))
"""

HASHED_WORDS = WORDS.strip() + "," + CRC


def staged(s: int = S, m: int = M, tail: str = "flush") -> str:
    where = f"WHERE (seq // {s * m} + 1) * {s * m} <= (SELECT max(seq) + 1 FROM ev)" if tail == "drop" else ""
    return f"""st AS (SELECT seq, key, CAST(seq % {s} AS INTEGER) AS source, seq // {s * m} + 1 AS period
      FROM ev {where})"""


def sketch(k: int = K, theta: float = THETA, hash_of=h) -> str:
    return f"""
kc AS (SELECT source, period, key, count(*) AS cnt FROM st GROUP BY ALL),
kn AS (SELECT source, period, count(*) AS n FROM st GROUP BY ALL),
hv AS (SELECT kc.* FROM kc JOIN kn USING (source, period) WHERE cnt >= ceil(CAST({theta} AS DOUBLE) * n)),
grid AS (SELECT source, period, CAST(b AS INTEGER) AS bucket
         FROM (SELECT DISTINCT source, period FROM st), range({k}) AS r(b)),
hist AS (SELECT g.source, g.period, g.bucket, CAST(coalesce(sum(c.cnt), 0) AS BIGINT) AS cnt
         FROM grid g LEFT JOIN (SELECT source, period, {hash_of('key', k)} AS bucket, cnt FROM kc) c
         USING (source, period, bucket) GROUP BY ALL),
taken AS (SELECT source, period, {hash_of('key', k)} AS bucket, CAST(sum(cnt) AS BIGINT) AS cnt FROM hv GROUP BY ALL),
sp AS (SELECT hist.source, hist.period, hist.bucket, hist.cnt - coalesce(taken.cnt, 0) AS cnt
       FROM hist LEFT JOIN taken USING (source, period, bucket)),
mh AS (SELECT period, key, CAST(sum(cnt) AS BIGINT) AS cnt FROM hv GROUP BY ALL),
mb AS (SELECT period, bucket, CAST(sum(cnt) AS BIGINT) AS cnt FROM sp GROUP BY ALL)"""


def placed(k: int = K, key_type: str = "BIGINT", order: str = "key") -> str:
    rank = "-cnt" if order == "load" else "0"
    zeros = f"CAST({[0] * k} AS BIGINT[])"
    least = "list_position(f.loads, list_min(f.loads))"
    return f"""
ops AS (SELECT period, 0 AS kind, 0 AS rank, CAST(NULL AS {key_type}) AS key, 0 AS cnt, list(cnt ORDER BY bucket) AS adds
        FROM mb GROUP BY period
        UNION ALL SELECT period, 1, {rank}, key, cnt, NULL FROM mh),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY period, kind, rank, key) AS i FROM ops),
fold(i, period, kind, key, cnt, worker, loads) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, CAST(NULL AS {key_type}), CAST(0 AS BIGINT), 0, {zeros}
  UNION ALL
  SELECT o.i, o.period, o.kind, o.key, o.cnt, CAST({least} - 1 AS INTEGER),
    CASE WHEN o.kind = 0 THEN list_transform(f.loads, lambda x, j: x + o.adds[j])
         ELSE list_transform(f.loads, lambda x, j: CASE WHEN j = {least} THEN x + o.cnt ELSE x END) END
  FROM fold f JOIN ordered o ON o.i = f.i + 1),
routing AS (SELECT period, key, worker, cnt FROM fold WHERE kind = 1),
loads AS (SELECT period, CAST(w AS INTEGER) AS worker, loads[w + 1] AS load
          FROM (SELECT period, arg_max(loads, i) AS loads FROM fold WHERE i > 0 GROUP BY period), range({k}) AS r(w))"""


def routed(k: int = K, hash_of=h) -> str:
    return f"""
routed AS (SELECT st.seq, st.key, st.source, st.period, coalesce(r.worker, {hash_of('st.key', k)}) AS worker
           FROM st LEFT JOIN routing r ON r.period = st.period AND r.key = st.key)"""


def hash_routed(k: int = K, hash_of=h, src: str = "st", cols: str = "seq, key, source, period") -> str:
    return f"routed AS (SELECT {cols}, {hash_of('key', k)} AS worker FROM {src})"


def online(k=K, s=S, m=M, theta=THETA, hash_of=h, key_type="BIGINT", order="key", base=EV, tail="flush") -> str:
    return ",\n".join(
        [base, staged(s, m, tail), sketch(k, theta, hash_of).strip(), placed(k, key_type, order).strip(), routed(k, hash_of).strip()]
    )


def dkg(k=K, theta=DKG_THETA, factor=FACTOR, learn=LEARN, first=0, hash_of=h, key_type="BIGINT", base=EV) -> str:
    import math

    buckets = math.ceil(k * factor)
    zeros = f"CAST({[0] * k} AS BIGINT[])"
    least = "list_position(f.loads, list_min(f.loads))"
    return f"""{base},
lr AS (SELECT * FROM ev WHERE seq < {learn}),
lc AS (SELECT key, count(*) AS cnt FROM lr GROUP BY ALL),
hv AS (SELECT * FROM lc WHERE cnt >= ceil(CAST({theta} AS DOUBLE) * (SELECT count(*) FROM lr))),
items AS (SELECT 'heavy' AS kind, key, CAST(NULL AS INTEGER) AS bucket, cnt FROM hv
  UNION ALL
  SELECT 'bucket', NULL, CAST(b AS INTEGER), CAST(coalesce(sum(c.cnt), 0) AS BIGINT)
  FROM range({buckets}) AS r(b) LEFT JOIN
    (SELECT {hash_of('key', buckets)} AS hb, cnt FROM lc WHERE key NOT IN (SELECT key FROM hv)) c ON c.hb = b
  GROUP BY b),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY cnt DESC, kind, bucket DESC, key) AS i FROM items),
fold(i, kind, key, bucket, cnt, worker, loads) AS (
  SELECT CAST(0 AS BIGINT), '', CAST(NULL AS {key_type}), CAST(NULL AS INTEGER), CAST(0 AS BIGINT), 0, {zeros}
  UNION ALL
  SELECT o.i, o.kind, o.key, o.bucket, o.cnt, CAST({least} - 1 AS INTEGER),
    list_transform(f.loads, lambda x, j: CASE WHEN j = {least} THEN x + o.cnt ELSE x END)
  FROM fold f JOIN ordered o ON o.i = f.i + 1),
placed AS (SELECT kind, key, bucket, cnt, worker FROM fold WHERE i > 0),
hm AS (SELECT key, worker FROM placed WHERE kind = 'heavy'),
bm AS (SELECT bucket, worker FROM placed WHERE kind = 'bucket'),
routed AS (SELECT e.seq, e.key, coalesce(hm.worker, bm.worker) AS worker
  FROM (SELECT *, {hash_of('key', buckets)} AS hb FROM ev WHERE seq >= {first}) e
  JOIN bm ON bm.bucket = e.hb LEFT JOIN hm ON hm.key = e.key)"""


def space_saving(counters: int) -> str:
    """All windows advance by one row per step; the least (count, key) makes room."""
    entry = "STRUCT(cnt BIGINT, key BIGINT, err BIGINT)"
    new = lambda cnt, err: f"CAST({{'cnt': {cnt}, 'key': o.key, 'err': {err}}} AS {entry})"
    return f"""
turn AS MATERIALIZED (SELECT source, period, key, row_number() OVER (PARTITION BY source, period ORDER BY seq) AS i FROM st),
fold(source, period, i, kept) AS (
  SELECT DISTINCT source, period, CAST(0 AS BIGINT), CAST([] AS {entry}[]) FROM turn
  UNION ALL
  SELECT o.source, o.period, o.i,
    CASE WHEN list_contains(list_transform(f.kept, lambda x: x.key), o.key)
         THEN list_transform(f.kept, lambda x: CASE WHEN x.key = o.key THEN CAST({{'cnt': x.cnt + 1, 'key': x.key, 'err': x.err}} AS {entry}) ELSE x END)
         WHEN len(f.kept) < {counters} THEN list_append(f.kept, {new('1', '0')})
         ELSE list_append(list_filter(f.kept, lambda x: x.key <> list_min(f.kept).key), {new('list_min(f.kept).cnt + 1', 'list_min(f.kept).cnt')}) END
  FROM fold f JOIN turn o ON o.source = f.source AND o.period = f.period AND o.i = f.i + 1),
counters AS (SELECT source, period, unnest(kept) AS e FROM (SELECT source, period, arg_max(kept, i) AS kept FROM fold GROUP BY ALL))"""


def two_choice(k=K, s=S, hash_of=h, base=EV) -> str:
    """All sources advance by one row per step."""
    zeros = f"CAST({[0] * k} AS BIGINT[])"
    pick = "CASE WHEN f.loads[o.c1 + 1] < f.loads[o.c2 + 1] THEN o.c1 ELSE o.c2 END"
    return f"""{base},
cand AS MATERIALIZED (SELECT seq, key, CAST(seq % {s} AS INTEGER) AS source, seq // {s} AS pos,
         {hash_of('key', k, 0)} AS c1, {hash_of('key', k, 1)} AS c2 FROM ev),
fold(source, pos, worker, loads) AS (
  SELECT CAST(g AS INTEGER), CAST(-1 AS BIGINT), 0, {zeros} FROM range({s}) AS r(g)
  UNION ALL
  SELECT o.source, o.pos, {pick},
    list_transform(f.loads, lambda x, j: CASE WHEN j = ({pick}) + 1 THEN x + 1 ELSE x END)
  FROM fold f JOIN cand o ON o.source = f.source AND o.pos = f.pos + 1),
routed AS (SELECT c.seq, c.key, c.source, f.worker FROM cand c JOIN fold f ON f.source = c.source AND f.pos = c.pos)"""


def loads_of(k: int = K, src: str = "routed", by: str = "") -> str:
    """Rows per worker with empty workers, optionally per group."""
    if by:
        return f"""wl AS (SELECT g.{by}, CAST(w AS INTEGER) AS worker, count(x.seq) AS load
  FROM (SELECT DISTINCT {by} FROM {src}) g CROSS JOIN range({k}) AS r(w)
  LEFT JOIN {src} x ON x.worker = w AND x.{by} = g.{by} GROUP BY ALL)"""
    return f"""wl AS (SELECT CAST(w AS INTEGER) AS worker, count(x.seq) AS load
  FROM range({k}) AS r(w) LEFT JOIN {src} x ON x.worker = w GROUP BY w)"""


def balance_sql(k: int = K, src: str = "wl", by: str = "", load: str = "load") -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"USING ({by})" if by else "ON true"
    return f"""
SELECT {lead}any_value(a.total) AS total, any_value(a.max_load) AS max_load, any_value(a.avg_load) AS avg_load,
  any_value(CASE WHEN a.avg_load = 0 THEN NULL ELSE (a.max_load / CAST(a.avg_load AS DOUBLE) - 1) * 100 END) AS imbalance,
  sqrt(sum(pow(CAST(l.{load} - a.avg_load AS DOUBLE), 2)) / {k}) AS sigma
FROM {src} l JOIN (SELECT {lead}CAST(sum({load}) AS BIGINT) AS total, max({load}) AS max_load,
  CAST(sum({load}) // {k} AS BIGINT) AS avg_load FROM {src} {group}) a {join} {group}"""


def period_totals(k: int = K) -> str:
    return loads_of(k, by="period") + """,
pt AS (SELECT period, worker, load, CAST(sum(load) OVER (PARTITION BY worker ORDER BY period) AS BIGINT) AS total FROM wl)"""


MIGRATION = """
mig AS (SELECT coalesce(o.period, n.period) AS period, coalesce(o.key, n.key) AS key, o.worker AS before, n.worker AS after,
          o.worker IS DISTINCT FROM n.worker AS moved
        FROM (SELECT period + 1 AS period, key, worker FROM routing WHERE period < (SELECT max(period) FROM routing)) o
        FULL JOIN routing n ON n.period = o.period AND n.key = o.key)"""


def w(*ctes: str, select: str) -> str:
    body = ",\n".join(c.strip().strip(",") for c in ctes)
    recursive = "RECURSIVE " if "fold(" in body else ""
    return f"WITH {recursive}{body}\n{select}"


def all_sql() -> dict[str, str]:
    hash_stream = (EV, staged(), hash_routed())
    on = online()
    sk = (EV, staged(), sketch())
    won = online(WK, WS, WM, WTHETA, hs, "VARCHAR", base=HASHED_WORDS)
    wdkg = dkg(WK, WTHETA, FACTOR, LEARN, 0, hs, "VARCHAR", base=HASHED_WORDS)
    complete = online(tail="drop")
    pm = "SELECT period, imbalance, sigma FROM (" + balance_sql(by="period", src="pt", load="total") + ")"
    tc = two_choice()
    sql = {
        # sources and sinks
        "scan_key_records": "SELECT event_id // 10 AS rec, CAST(event_id % 10 AS INTEGER) AS pos, event_id AS seq, user_id AS key FROM events",
        "scan_access_log": """SELECT row_number() OVER (ORDER BY page_id) - 1 AS seq, split(line, ' ')[3] AS key FROM (
SELECT page_id, concat_ws(' ', page_id, length(html), url, '-') AS line FROM pages
WHERE page_id % 5 <> 4 AND page_id % 7 <> 6)""",
        "access_log_short_lines": """SELECT count(*) AS lines, count(*) FILTER (page_id % 5 = 4) AS short_lines
FROM pages WHERE page_id % 7 <> 6""",
        "zipf_source": f"""WITH t AS (SELECT i, CAST(floor(sum(pow(i, -{ZIPF_Z})) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)
  / sum(pow(i, -{ZIPF_Z})) OVER () * 4503599627370496) AS BIGINT) AS up FROM range(1, {ZIPF_N + 1}) AS r(i)),
u AS (SELECT event_id AS seq, CAST('0x' || substr(md5('{ZIPF_SEED}:' || event_id), 1, 13) AS BIGINT) AS x FROM events)
SELECT seq, coalesce(t.i, 0) + 1 AS key FROM u ASOF LEFT JOIN t ON u.x >= t.up""",
        "zipf_source_wide": f"""WITH hd AS (SELECT i, sum(1 / CAST(i AS DOUBLE)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM range(1, 1025) AS r(i)),
tot AS (SELECT max(s) + (ln({ZIPF_WIDE}) + 0.5 / {ZIPF_WIDE} - pow({ZIPF_WIDE}, -2.0) / 12) - (ln(1024) + 0.5 / 1024 - pow(1024, -2.0) / 12) AS t FROM hd),
th AS (SELECT i, CAST(floor(s / t * 4503599627370496) AS BIGINT) AS up FROM hd, tot),
u AS (SELECT event_id AS seq, CAST('0x' || substr(md5('{ZIPF_SEED}:' || event_id), 1, 13) AS BIGINT) AS x FROM events)
SELECT seq, CASE WHEN coalesce(th.i, 0) < 1024 THEN coalesce(th.i, 0) + 1 END AS key, true AS valid FROM u ASOF LEFT JOIN th ON u.x >= th.up""",
        "stream_prefix": f"SELECT event_id AS seq, user_id AS key FROM events WHERE event_id < {LEARN}",
        "sink_period_stats": w(*hash_stream, period_totals(), select=pm),
        "route_to_partitions": w(EV, hash_routed(src="ev", cols="seq, key"), select="SELECT worker, worker AS part, count(*) AS cnt FROM routed GROUP BY ALL"),
        "route_to_split_partitions": w(EV, hash_routed(src="ev", cols="seq, key"), select="SELECT worker, CAST(worker * 3 + seq % 3 AS INTEGER) AS part, count(*) AS cnt FROM routed GROUP BY ALL"),
        # projections and filters
        "key_select": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS key FROM pages",
        "source_round_robin": f"SELECT event_id AS seq, CAST(event_id % {S} AS INTEGER) AS source FROM events",
        "period_assign": w(EV, staged(), select="SELECT seq, source, period FROM st"),
        "period_assign_by_position": f"""SELECT event_id AS seq, CAST(user_id % {S} AS INTEGER) AS source,
(row_number() OVER (PARTITION BY user_id % {S} ORDER BY event_id) - 1) // {M} + 1 AS period FROM events""",
        "learn_assign_split": f"""SELECT 'learn' AS phase, event_id AS seq, user_id AS key FROM events WHERE event_id < {LEARN}
UNION ALL SELECT 'route', event_id, user_id FROM events WHERE event_id >= {LEARN}""",
        "complete_periods": w(EV, staged(tail="drop"), select="SELECT seq, source, period FROM st"),
        "complete_periods_flush": w(EV, staged(), select="SELECT seq, source, period FROM st"),
        "complete_periods_counted": w(EV, staged(), select=f"""SELECT seq, source, period FROM st WHERE period IN (
SELECT period FROM (SELECT period, source, count(*) AS n FROM st GROUP BY ALL) WHERE n = {M} GROUP BY period HAVING count(*) = {S})"""),
        "heavy_hitter_filter": w(WORDS, select="""SELECT key, count(*) AS cnt FROM ev GROUP BY key
HAVING count(*) >= ceil(CAST(0.005 AS DOUBLE) * (SELECT count(*) FROM ev))"""),
        # functions
        "hash_murmur": murmur("SELECT event_id AS seq, user_id AS key FROM events", K, MURMUR),
        "hash_cw_int": f"SELECT event_id AS seq, {h('user_id', K)} AS worker FROM events",
        "hash_cw_string": w(HASHED_WORDS, select=f"SELECT key, {hs('key', WK)} AS worker, count(*) AS cnt FROM ev GROUP BY ALL"),
        "hash_md5_string": w(WORDS, select=f"SELECT key, {h(fold_md5('key'), WK)} AS worker FROM (SELECT DISTINCT key FROM ev)"),
        "hash_string_fold": w(WORDS, select="""SELECT key, abs(CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END) AS folded FROM (
SELECT key, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(split(key, ''), lambda c: CAST(unicode(c) AS BIGINT))),
  lambda a, c: (a * 31 + c) % 4294967296) AS x FROM (SELECT DISTINCT key FROM ev))"""),
        "hash_candidates_murmur": " UNION ALL ".join(
            f"SELECT seq, worker FROM ({murmur('SELECT event_id AS seq, user_id AS key FROM events', K, seed)})" for seed in MURMUR_PRIMES
        ),
        "hash_candidates": f"SELECT event_id AS seq, {h('user_id', K)} AS first, {h('user_id', K, 1)} AS second FROM events",
        "harmonic_number": """SELECT z, round(sum(pow(event_id + 1, -z)), 9) AS harmonic
FROM events, (VALUES (CAST(1.0 AS DOUBLE)), (2.0), (3.0)) AS v(z) GROUP BY z""",
        "routing_size_estimate": "SELECT round(pow(CAST(0.0001 AS DOUBLE) * sum(pow(event_id + 1, -2.0)), -0.5), 6) AS table_size FROM events",
        # sketches
        "heavy_hitters": w(*sk, select="SELECT source, period, key, cnt FROM hv"),
        "space_saving": w(*sk, select="SELECT source, period, key, cnt FROM hv"),
        "frequent_sketch": w(*sk, select="SELECT source, period, key, cnt FROM hv"),
        "space_saving_merged": w(WORDS, select=f"""SELECT key, count(*) AS cnt, true AS bounded FROM ev GROUP BY key
HAVING count(*) * {WORD_COUNTERS} > (SELECT count(*) FROM ev)"""),
        "space_saving_evicting": w(EV, staged(), space_saving(COUNTERS), select='SELECT source, period, e.key AS key, e.cnt AS "count", e.err AS err FROM counters'),
        "bucket_histogram": w(*sk, select="SELECT source, period, bucket, cnt FROM hist"),
        "sparse_residual": w(*sk, select="SELECT source, period, bucket, cnt FROM sp"),
        "sketch_merge": w(*sk, select="SELECT period, key, cnt FROM mh"),
        "sketch_merge_buckets": w(*sk, select="SELECT period, bucket, cnt FROM mb"),
        "sketch_conservation": w(EV, staged(tail="drop"), select=f"SELECT source, period, count(*) AS mass, count(*) = {M} AS conserved FROM st GROUP BY ALL"),
        "distinct_keys_hll": w(WORDS, select="SELECT count(DISTINCT key) AS distinct_keys, true AS near FROM ev"),
        "distinct_keys": w(WORDS, select="SELECT count(DISTINCT key) AS distinct_keys FROM ev"),
        "keyed_count": w(EV, hash_routed(src="ev", cols="seq, key"), select="SELECT worker, key, count(*) AS cnt FROM routed GROUP BY ALL"),
        "keyed_count_merge": w(tc, select="SELECT key, count(*) AS cnt, count(DISTINCT worker) AS workers FROM routed GROUP BY key"),
        "worker_load": w(EV, hash_routed(src="ev", cols="seq, key"), loads_of(), select="SELECT worker, load FROM wl"),
        # placement
        "least_loaded": w(*hash_stream, period_totals(), select="SELECT period, arg_min(worker, total * 1000 + worker) AS worker FROM pt GROUP BY period"),
        "place_heavy_online": w(on, select="SELECT period, key, worker FROM routing"),
        "place_heavy_by_load": w(online(order="load"), select="SELECT period, key, worker FROM routing"),
        "placement_loads": w(on, select="SELECT period, worker, load FROM loads"),
        "place_lpt": w(dkg(), select="SELECT kind, key, bucket, cnt, worker FROM placed"),
        "heavy_sorted": w(*sk, select="SELECT period, key, cnt, row_number() OVER (PARTITION BY period ORDER BY cnt DESC, key) AS place FROM mh"),
        "top_heavy": w(*sk, select="SELECT period, key, cnt FROM mh ORDER BY cnt DESC, period, key LIMIT 20"),
        "placement_items": w(dkg(), select="SELECT kind, key, bucket, cnt FROM items"),
        # routing
        "route_lookup": w(on, select="SELECT seq, key, period, worker FROM routed"),
        "route_lookup_in_place": w(on, select="SELECT seq, key, period, worker FROM routed"),
        "route_two_level": w(dkg(), select="SELECT seq, key, worker FROM routed"),
        "migration_plan": w(on, MIGRATION, select="SELECT period, key, before, after, moved FROM mig"),
        "state_relocate": w(on, MIGRATION, select=f"""SELECT coalesce(m.after, {h('s.key', K)}) AS worker, s.key, CAST(sum(s.cnt) AS BIGINT) AS cnt
FROM (SELECT worker, key, count(*) AS cnt FROM routed GROUP BY ALL) s
LEFT JOIN (SELECT * FROM mig WHERE period = (SELECT max(period) FROM mig)) m ON m.key = s.key GROUP BY 1, 2"""),
        "routing_kept": w(on, MIGRATION, select="SELECT period, key, before, after, moved FROM mig WHERE before IS NOT NULL AND after IS NOT NULL"),
        "routing_dropped": w(on, MIGRATION, select="SELECT period, key, before FROM mig WHERE after IS NULL"),
        "routing_added": w(on, MIGRATION, select="SELECT period, key, after FROM mig WHERE before IS NULL"),
        # strategies
        "group_hash": w(EV, hash_routed(src="ev", cols="seq, key"), select="SELECT seq, key, worker FROM routed"),
        "group_two_choice": w(tc, select="SELECT seq, key, source, worker FROM routed"),
        "group_two_choice_hot": w(two_choice(HOT_K, base=HOT_EV), select="SELECT seq, key, source, worker FROM routed"),
        "group_dkg": w(dkg(), select="SELECT seq, key, worker FROM routed"),
        "group_dkg_discard": w(dkg(first=LEARN + SKIP), select="SELECT seq, key, worker FROM routed"),
        "group_online_drop": w(complete, select="SELECT seq, key, source, period, worker FROM routed"),
        "group_online_short_periods": w(online(m=SHORT_M, theta=SHORT_THETA), select="SELECT seq, key, source, period, worker FROM routed"),
        "group_online": w(on, select="SELECT seq, key, source, period, worker FROM routed"),
        "group_hash_words": w(HASHED_WORDS, hash_routed(WK, hs, "ev", "seq, key"), select="SELECT seq, key, worker FROM routed"),
        "group_dkg_words": w(wdkg, select="SELECT seq, key, worker FROM routed"),
        "group_two_choice_words": w(two_choice(WK, WS, hs, HASHED_WORDS), select="SELECT seq, key, worker FROM routed"),
        "group_online_words": w(won, select="SELECT seq, key, source, period, worker FROM routed"),
        "custom_grouping": f"SELECT event_id AS seq, user_id AS key, CAST(user_id % {K} AS INTEGER) AS worker FROM events",
        "custom_ordered_grouping": f"""SELECT event_id AS seq, user_id AS key, CAST((row_number() OVER
(PARTITION BY event_id % {S}, event_id // {S * M} ORDER BY event_id) - 1) % {K} AS INTEGER) AS worker FROM events""",
        # metrics
        "load_summary": w(EV, hash_routed(src="ev", cols="seq, key"), loads_of(), select="SELECT total, max_load, avg_load FROM (" + balance_sql() + ")"),
        "imbalance": w(EV, hash_routed(src="ev", cols="seq, key"), loads_of(), select="SELECT imbalance FROM (" + balance_sql() + ")"),
        "load_stddev": w(EV, hash_routed(src="ev", cols="seq, key"), loads_of(), select="SELECT sigma FROM (" + balance_sql() + ")"),
        "period_imbalance": w(on, period_totals(), select=pm),
        "period_worker_load": w(on, period_totals(), select="SELECT period, worker, load, total FROM pt"),
        "compile_stats": w(on, MIGRATION, select="""SELECT p.period, (SELECT count(*) FROM routing r WHERE r.period = p.period) AS routing_size,
(SELECT count(*) FROM mig WHERE mig.period = p.period) AS migration_size FROM (SELECT DISTINCT period FROM st) p"""),
        "sink_compile_stats": w(on, MIGRATION, select="""SELECT p.period, (SELECT count(*) FROM routing r WHERE r.period = p.period) AS routing_size,
(SELECT count(*) FROM mig WHERE mig.period = p.period) AS migration_size, true AS timed FROM (SELECT DISTINCT period FROM st) p"""),
        "source_counts": w(EV, staged(), select="SELECT source, count(*) AS cnt FROM st GROUP BY source"),
        "source_delay": f"""SELECT count(*) AS sources, CAST(sum(mean_us) // count(*) AS BIGINT) AS delay_us FROM (
SELECT source, sum(d) // count(*) AS mean_us FROM (
SELECT event_id % {S} AS source, event_id // {S * M} AS period, epoch_us(max(ts)) - epoch_us(min(ts)) AS d FROM events GROUP BY 1, 2) GROUP BY source)""",
    }
    both = {"hash": w(EV, hash_routed(src="ev", cols="seq, key"), loads_of(), select=balance_sql()),
            "two_choice": w(tc, loads_of(), select=balance_sql()),
            "dkg": w(dkg(), loads_of(), select=balance_sql()),
            "online": w(on, loads_of(), select=balance_sql())}
    sql["group_compare"] = "\nUNION ALL\n".join(f"SELECT '{name}' AS strategy, * FROM ({q})" for name, q in both.items())
    # streams give what the batch forms give
    sql["stream_hash"] = sql["group_hash"]
    sql["stream_online"] = sql["group_online"]
    sql["stream_two_choice"] = sql["group_two_choice"]
    sql["stream_learned"] = sql["group_dkg"]
    sql["stream_count_window"] = w(EV, staged(), select=f"""SELECT seq, key, source, period FROM (
SELECT *, count(*) OVER (PARTITION BY source, period) AS n FROM st) WHERE n = {M}""")
    sql["stream_count_window_flush"] = w(EV, staged(), select="SELECT seq, key, source, period FROM st")
    # Statistics and plans of a live stream are about periods that are complete.
    sql["stream_period_barrier"] = w(complete, period_totals(), select="SELECT period, worker, load, total FROM pt")
    sql["stream_migration"] = w(complete, MIGRATION, select="SELECT period, key, before, after, moved FROM mig")
    sql["stream_keyed_state"] = w(on, select=f"""SELECT coalesce(r.worker, {h('k.key', K)}) AS worker, k.key, k.cnt
FROM (SELECT key, count(*) AS cnt FROM ev GROUP BY key) k
LEFT JOIN (SELECT * FROM routing WHERE period = (SELECT max(period) FROM st)) r ON r.key = k.key""")
    sql["stream_drain"] = w(on, loads_of(), select=balance_sql())
    return sql
