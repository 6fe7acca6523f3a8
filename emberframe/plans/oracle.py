"""SQL (DuckDB dialect) that gives the rows of the named queries from the same tables."""

EV = "ev AS (SELECT *, epoch_us(ts) AS us, CAST(ROUND(value * 100) AS BIGINT) AS cents FROM events)"

TRACE = EV + """,
tr AS (
  SELECT event_id, us, (us - (SELECT MIN(us) FROM ev)) * 1000 AS ts, user_id AS g, CAST(-1 AS BIGINT) AS p,
         CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 WHEN 'error' THEN 4
              WHEN 'purchase' THEN 1000 END AS BIGINT) AS type,
         cents AS val
  FROM ev)"""

SAMPLES = """samples AS (
  SELECT CAST(year(o_orderdate) AS VARCHAR) AS snapshot_id, [r_name, n_name, c_mktsegment, o_orderpriority] AS stack,
         CAST(l_quantity AS BIGINT) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def build(name: str, source: str, key: str | None = "snapshot_id") -> str:
    """Roll-up of four-level samples as a CTE: path as text, depth, name, value."""
    keys, group = (f"{key},", f"{key}, ") if key else ("", "")
    return f"""{name} AS (
  SELECT {keys} array_to_string(stack[1:d], ';') AS path, CAST(d AS BIGINT) AS depth,
         CASE WHEN d = 0 THEN 'root' ELSE stack[d] END AS name,
         CAST(SUM(CASE WHEN d > 0 THEN weight ELSE 0 END) AS BIGINT) AS value
  FROM {source}, (SELECT unnest(range(0, 5)) AS d) depths
  GROUP BY {group} d, stack[1:d], CASE WHEN d = 0 THEN 'root' ELSE stack[d] END)"""


FRAMES = SAMPLES + ",\n" + build("frames", "samples")
YEARS = (
    SAMPLES
    + ",\n" + build("head", "(SELECT * FROM samples WHERE snapshot_id = '1997')")
    + ",\n" + build("base", "(SELECT * FROM samples WHERE snapshot_id = '1996')")
)
MERGED = SAMPLES + ",\n" + build("tree", "samples", None)


def below(node: str, other: str) -> str:
    """Condition: ``other`` is ``node`` or lies below it."""
    return f"({node}.depth = 0 OR {other}.path = {node}.path OR starts_with({other}.path, {node}.path || ';'))"


def flatten(name: str, source: str, key: str | None = "snapshot_id") -> str:
    same = f"c.{key} = n.{key} AND " if key else ""
    keys = f"n.{key}, " if key else ""
    return f"""{name} AS (
  SELECT {keys} n.path, n.name, n.depth, n.value AS self, CAST(SUM(c.value) AS BIGINT) AS cumulative,
         CAST(n.value - COALESCE(SUM(c.value) FILTER (WHERE c.depth = n.depth + 1), 0) AS BIGINT) AS self_exclusive
  FROM {source} n JOIN {source} c ON {same} {below('n', 'c')}
  GROUP BY {keys} n.path, n.name, n.depth, n.value)"""


READINGS = EV + """,
readings AS (
  SELECT user_id AS process_id, us, event_id, cents AS heap_alloc,
         LAG(cents) OVER w AS profiled,
         CAST(SUM(event_id % 3) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS num_gc
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))"""

CHUNKS = EV + """,
chunks AS (SELECT ROW_NUMBER() OVER (ORDER BY us, event_id) AS seq, us, props AS payload FROM ev)"""

FAST_CHUNKS = CHUNKS + """,
fast AS (SELECT seq, us // 1000 AS us, payload FROM chunks),
ring AS (
  SELECT * FROM fast WHERE seq > (SELECT MAX(seq) FROM fast) - 9001
  AND ((SELECT MAX(seq) FROM fast) < 9001 OR us >= (SELECT MAX(us) FROM fast) - 900000000))"""

METRICS = EV + """,
metrics AS (
  SELECT us // 3600000000 * 3600000000 AS us,
         CAST(COUNT(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS click,
         CAST(COUNT(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS error,
         CAST(COUNT(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS purchase,
         CAST(COUNT(*) FILTER (WHERE event_type = 'signup') AS DOUBLE) AS signup,
         CAST(COUNT(*) FILTER (WHERE event_type = 'view') AS DOUBLE) AS view
  FROM ev GROUP BY 1)"""

OUTCOMES = METRICS + """,
outcomes AS (
  SELECT us, 'busy' AS rule, click > 3 AS holds FROM metrics UNION ALL
  SELECT us, 'ratio', CASE WHEN view = 0 THEN 0 ELSE error / view END >= 1 AND purchase < 5 FROM metrics UNION ALL
  SELECT us, 'spread', signup - 3 <> 0 FROM metrics UNION ALL
  SELECT us, 'unknown', TRUE FROM metrics UNION ALL
  SELECT us, 'both', click <> 0 AND NOT error <> 0 FROM metrics UNION ALL
  SELECT us, 'several', (click > 1)::INT + (view > 1)::INT + (error > 0)::INT >= 2 FROM metrics UNION ALL
  SELECT us, 'quiet', error <= 1 FROM metrics)"""

TABLE_RULES = """,
limits(rule, hold_us) AS (VALUES ('busy', 7200000000), ('ratio', 10800000000), ('spread', 3600000000), ('unknown', 0)),
o AS (SELECT outcomes.*, hold_us FROM outcomes JOIN limits USING (rule)),
"""


def hold(source: str, keys: str, order: str, hold_us: int | str) -> str:
    """Gaps and islands: first row of each unbroken run at least ``hold_us`` after the run's first row."""
    return f"""marked AS (
  SELECT *, SUM(CASE WHEN holds THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS island
  FROM {source}),
runs AS (SELECT *, MIN(us) OVER (PARTITION BY {keys}, island) AS since_us FROM marked WHERE holds),
ripe AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys}, island ORDER BY {order}) AS nth FROM runs WHERE us - since_us >= {hold_us})
SELECT {keys}, {order}, since_us FROM ripe WHERE nth = 1"""


ANNOTATIONS = EV + """,
annotations AS (
  SELECT user_id AS gid, us, event_id,
         md5(CAST(event_id AS VARCHAR)) || ':' ||
         CASE WHEN event_id % 2 = 0 THEN substr(md5(CAST(event_id AS VARCHAR)), 1, 16) ELSE '0000000000000000' END AS label
  FROM ev WHERE event_type = 'signup')"""

PART_STACKS = """names AS (
  SELECT p_partkey, ['example.com/parts/' || p_brand || '.' || p_type, '', 'net/http.Serve',
                     'main.' || replace(p_name, ' ', '_'), 'runtime.main', 'runtime.goexit'] AS names
  FROM part),
stacks AS (
  SELECT p_partkey, list_reverse([x FOR x IN [regexp_replace(y, '^.*/', '') FOR y IN names IF y <> '']
                                  IF x NOT IN ('runtime.main', 'runtime.goexit')]) AS stack
  FROM names)"""

TRACE_ROWS = "SELECT ts, g, p, type, val FROM tr"
FRAME_ROWS = "SELECT snapshot_id, path, name, value FROM frames"
DEDUP = """,
numbered AS (SELECT event_type || '/' || user_id AS rule, us, event_id, ROW_NUMBER() OVER (ORDER BY us, event_id) AS i FROM ev),
linked AS (SELECT *, LAG(i) OVER (PARTITION BY rule ORDER BY i) AS p FROM numbered),
others AS (
  SELECT a.i, COUNT(*) AS n FROM linked a JOIN linked b
  ON b.i > a.p AND b.i < a.i AND (b.p IS NULL OR b.p < a.p) GROUP BY a.i)
SELECT rule, us, event_id FROM linked LEFT JOIN others USING (i) WHERE p IS NULL OR COALESCE(n, 0) >= 128"""


LINE_SAMPLES = """s AS (
  SELECT epoch_us(l_shipdate) AS us, l_returnflag AS process_id, [c_mktsegment, o_orderpriority] AS stack, CAST(l_quantity AS BIGINT) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def with_(cte: str, select: str) -> str:
    return f"WITH {cte}\n{select}"


DIFF = with_(
    YEARS,
    f""", delta AS (
  SELECT COALESCE(h.path, b.path) AS path, COALESCE(h.depth, b.depth) AS depth, COALESCE(h.name, b.name) AS name,
     COALESCE(h.value, 0) - COALESCE(b.value, 0) AS delta
  FROM head h FULL OUTER JOIN base b ON h.path = b.path)
SELECT path, name, delta FROM delta n WHERE EXISTS (SELECT 1 FROM delta c WHERE c.delta <> 0 AND {below('n', 'c')})""",
)

FLATTEN_KEY = "string_split(CASE path WHEN '' THEN chr(1114111) ELSE path || ';' || chr(1114111) END, ';')"

ORACLE: dict[str, str] = {
    "read_trace_ndjson": with_(TRACE, TRACE_ROWS),
    "read_snapshots": with_(FRAMES, FRAME_ROWS),
    "write_snapshots": with_(FRAMES, FRAME_ROWS),
    "tree_explode": with_(FRAMES, FRAME_ROWS),
    "tree_to_json": with_(
        FRAMES,
        """, parts AS (SELECT *, regexp_replace(path, ';?[^;]*$', '') AS parent FROM frames WHERE depth > 0),
l4 AS (SELECT snapshot_id, parent, string_agg('"' || name || '":{"name":"' || name || '","value":' || value || '}', ',' ORDER BY name) AS children
       FROM parts WHERE depth = 4 GROUP BY ALL),
l3 AS (SELECT p.snapshot_id, p.parent, string_agg('"' || name || '":{"name":"' || name || '","value":' || value || ',"children":{' || children || '}}', ',' ORDER BY name) AS children
       FROM parts p JOIN l4 c ON p.snapshot_id = c.snapshot_id AND p.path = c.parent WHERE depth = 3 GROUP BY ALL),
l2 AS (SELECT p.snapshot_id, p.parent, string_agg('"' || name || '":{"name":"' || name || '","value":' || value || ',"children":{' || children || '}}', ',' ORDER BY name) AS children
       FROM parts p JOIN l3 c ON p.snapshot_id = c.snapshot_id AND p.path = c.parent WHERE depth = 2 GROUP BY ALL),
l1 AS (SELECT p.snapshot_id, string_agg('"' || name || '":{"name":"' || name || '","value":' || value || ',"children":{' || children || '}}', ',' ORDER BY name) AS children
       FROM parts p JOIN l2 c ON p.snapshot_id = c.snapshot_id AND p.path = c.parent WHERE depth = 1 GROUP BY ALL)
SELECT snapshot_id, '{"name":"root","value":0,"children":{' || children || '}}' AS payload FROM l1""",
    ),
    "ingest_stream": with_(CHUNKS, "SELECT * FROM chunks"),
    "replay_then_tail": with_(CHUNKS, "SELECT * FROM chunks"),
    "multi_sink": with_(
        EV, "SELECT 'first' AS sink, us, props AS payload FROM ev UNION ALL SELECT 'second', us, props FROM ev"
    ),
    "by_time_range": with_(
        TRACE,
        TRACE_ROWS + " WHERE us >= epoch_us(TIMESTAMP '2024-01-05') AND us < epoch_us(TIMESTAMP '2024-01-20 12:00:00')",
    ),
    "by_goroutine": with_(TRACE, TRACE_ROWS + " WHERE g = 7"),
    "by_event_types": with_(TRACE, TRACE_ROWS + " WHERE type IN (4, 1000)"),
    "event_wall_time": "SELECT event_id, epoch_us(ts) AS wall_us FROM events",
    "sample_admission": """WITH s AS (
  SELECT l_orderkey, [x FOR x IN [l_returnflag, l_linestatus] IF x NOT IN ('A', 'F')] AS stack, CAST(l_quantity - 25 AS BIGINT) AS weight
  FROM lineitem)
SELECT l_orderkey, array_to_string(stack, ';') AS path, weight FROM s WHERE len(stack) > 0 AND weight <> 0""",
    "normalise_stack": with_(PART_STACKS, "SELECT p_partkey, array_to_string(stack, ';') AS path FROM stacks"),
    "trim_package": "SELECT page_id, regexp_replace(url, '^.*/', '') AS name FROM pages",
    "exclude_packages": with_(
        PART_STACKS,
        """SELECT p_partkey, array_to_string([x FOR x IN stack IF split_part(x, '.', 1) NOT IN ('runtime', 'http', 'reflect')], ';') AS path
FROM stacks""",
    ),
    "flame_search": with_(
        FRAMES,
        f"""SELECT n.snapshot_id, n.path, n.name, n.value, contains(lower(n.name), 'nation_1') AS matched FROM frames n
WHERE EXISTS (SELECT 1 FROM frames h WHERE h.snapshot_id = n.snapshot_id AND contains(lower(h.name), 'nation_1') AND {below('n', 'h')})""",
    ),
    "ancestor_closure": with_(
        FRAMES,
        """SELECT DISTINCT snapshot_id, array_to_string(string_split(path, ';')[1:d], ';') AS path
FROM frames, (SELECT unnest(range(0, 5)) AS d) depths WHERE depth = 4""",
    ),
    "threshold_filter": with_(METRICS, "SELECT us, error FROM metrics WHERE error >= 3"),
    "rule_eval": with_(OUTCOMES, "SELECT us, rule, holds FROM outcomes"),
    "frame_band": with_(
        EV,
        """SELECT event_id,
  CASE event_type WHEN 'purchase' THEN 'heap' WHEN 'error' THEN 'blocked' WHEN 'view' THEN 'gc'
       ELSE CASE WHEN cents - 2000 < 0 THEN 'shrinking' ELSE 'other' END END AS band,
  CAST(sign(cents - 2000) AS BIGINT) AS sign FROM ev""",
    ),
    "stable_hash_bucket": """WITH names AS (SELECT c_name AS name FROM customer UNION SELECT url FROM pages),
hashed AS (
  SELECT name, list_reduce(
    list_prepend(CAST(2166136261 AS BIGINT), [CAST('0x' || substr(hex(encode(name)), 2 * i + 1, 2) AS BIGINT) FOR i IN range(0, strlen(name))]),
    lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS hash
  FROM names)
SELECT name, hash, hash % 360 AS bucket FROM hashed""",
    "scalar_functions": with_(
        EV,
        """SELECT event_id, ROUND((us % 1000000000) / 1000000, 2) AS ms,
  strftime(make_timestamp(us), '%Y%m%dT%H%M%S.%g') AS file_time, greatest(least(cents, 5000), 500) AS clamped FROM ev""",
    ),
    "child_key_union": """WITH k AS (
  SELECT n_regionkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION
  SELECT n_regionkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS keys FROM k GROUP BY 1""",
    "flame_diff": DIFF,
    "snapshot_diff": DIFF,
    "diff_files": DIFF.replace("SELECT path, name, delta FROM", "SELECT path, name, delta AS value FROM"),
    "replay_files": with_(
        SAMPLES + ",\n" + build("frames", "(SELECT * FROM samples WHERE snapshot_id IN ('1996', '1997'))") + ",\n" + flatten("flat", "frames"),
        """SELECT snapshot_id, COUNT(*) AS nodes, MAX(cumulative) FILTER (WHERE depth = 0) AS total_cumulative,
  CAST(SUM(self) AS BIGINT) AS total_self FROM flat GROUP BY snapshot_id""",
    ),
    "trace_attach": with_(
        ANNOTATIONS,
        """, f AS (
  SELECT event_id, us, user_id, CAST(event_id AS VARCHAR) AS snapshot_id, 'goroutine-' || user_id AS name, cents AS value
  FROM ev WHERE event_type <> 'signup'),
attached AS (
  SELECT f.snapshot_id, f.name, arg_max(a.label, (a.us, a.event_id)) AS label
  FROM f JOIN annotations a ON a.gid = f.user_id AND a.us <= f.us AND f.us - a.us <= 86400000000 GROUP BY ALL)
SELECT snapshot_id, name AS path, name, value FROM f UNION ALL
SELECT snapshot_id, name || ';_trace', label, CAST(0 AS BIGINT) FROM attached""",
    ),
    "symbolise": """WITH calls AS (
  SELECT l_orderkey AS sample_id, l_linenumber, l_partkey,
         ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos, l_partkey * 10 + l_linenumber AS pc
  FROM lineitem)
SELECT sample_id, string_agg(p_brand || '.' || p_type, ';' ORDER BY pos DESC) AS path
FROM calls JOIN part ON pc - 1 >= p_partkey * 10 AND pc - 1 < p_partkey * 10 + 10 WHERE pc <> 0 GROUP BY sample_id""",
    "agent_enrich": """SELECT event_id, lower(c_name) AS hostname, 'v1.' || (c_custkey % 5) AS version, c_custkey % 32768 AS pid,
  c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM events LEFT JOIN customer ON user_id = c_custkey""",
    "flame_build": with_(FRAMES, FRAME_ROWS),
    "flame_merge": with_(
        FRAMES,
        "SELECT path, name, CAST(SUM(value) AS BIGINT) AS value FROM frames GROUP BY path, name",
    ),
    "flame_flatten": with_(FRAMES + ",\n" + flatten("flat", "frames"), "SELECT * FROM flat"),
    "replay_summary": with_(
        FRAMES + ",\n" + flatten("flat", "frames"),
        """SELECT snapshot_id, COUNT(*) AS nodes, MAX(cumulative) FILTER (WHERE depth = 0) AS total_cumulative,
  CAST(SUM(self) AS BIGINT) AS total_self FROM flat GROUP BY snapshot_id""",
    ),
    "sum_by_type": with_(TRACE, "SELECT type, CAST(SUM(val) AS BIGINT) AS total FROM tr GROUP BY type"),
    "metric_rollup": with_(
        EV,
        """SELECT user_id AS process_id,
  COALESCE(arg_max(event_id % 100, (us, event_id)) FILTER (WHERE event_type = 'error'), -1) AS blocked_goroutines,
  COALESCE(arg_max(cents, (us, event_id)) FILTER (WHERE event_type = 'purchase'), -1) AS heap_bytes,
  CAST(COALESCE(SUM(cents) FILTER (WHERE event_type = 'view'), 0) AS BIGINT) AS gc_pause_total_ns,
  COUNT(*) AS chunks_received_total FROM ev GROUP BY user_id""",
    ),
    "heap_delta": with_(
        READINGS,
        """SELECT process_id, us, event_id, '(Heap)' AS path, heap_alloc - profiled AS weight FROM readings
WHERE heap_alloc <> profiled""",
    ),
    "gc_unroll": with_(
        READINGS,
        """, steps AS (
  SELECT *, LAG(num_gc) OVER (PARTITION BY process_id ORDER BY us, event_id) AS before FROM readings),
cycles AS (SELECT process_id, us, event_id, unnest(range(before, num_gc)) AS cycle FROM steps),
pauses AS (SELECT *, (process_id * 7 + cycle % 256 * 13) % 11 * 1000 AS weight FROM cycles)
SELECT * FROM pauses WHERE weight <> 0""",
    ),
    "blocked_estimate": with_(
        READINGS,
        "SELECT process_id, us, event_id, heap_alloc - profiled AS weight FROM readings WHERE heap_alloc > profiled",
    ),
    "downsample": with_(
        TRACE,
        ", n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY ts, event_id) AS rn FROM tr) SELECT ts, g, p, type, val FROM n WHERE (rn - 1) % 7 = 0",
    ),
    "rate_limit": with_(
        EV,
        """, r AS (SELECT event_type AS process_id, us // 3600 AS us, event_id FROM ev),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY process_id, us // 1000000 ORDER BY us, event_id) AS rn FROM r)
SELECT process_id, us, event_id FROM n WHERE rn = 1""",
    ),
    "retain_ring": with_(FAST_CHUNKS, "SELECT * FROM ring"),
    "retain_list": with_(
        CHUNKS,
        """, gaps AS (SELECT *, us - LAG(us) OVER (ORDER BY seq) >= 1800000000 AS starts FROM chunks)
SELECT seq, us, payload FROM chunks WHERE seq > (SELECT MAX(seq) FROM chunks) - 18101
AND seq >= COALESCE((SELECT MAX(seq) FROM gaps WHERE starts), 1)""",
    ),
    "timeline_seek": with_(
        FAST_CHUNKS,
        """, newest AS (SELECT * FROM ring WHERE seq > (SELECT MAX(seq) FROM ring) - 100),
n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY seq) - 1 AS i FROM newest)
SELECT seq, us, payload, 'index 17' AS what FROM n WHERE i = 17 UNION ALL
SELECT seq, us, payload, 'last' FROM ring WHERE seq = (SELECT MAX(seq) FROM ring)""",
    ),
    "alert_dedup_lru": with_(EV, DEDUP),
    "rules_hold": with_(OUTCOMES + TABLE_RULES, hold("o", "rule", "us", "hold_us")),
    "alert_route": with_(
        OUTCOMES + TABLE_RULES,
        "fired AS (WITH "
        + hold("o", "rule", "us", "hold_us")
        + """), routes(rule, sink) AS (VALUES ('busy', 'chat'), ('busy', 'pager'), ('ratio', 'issues'), ('unknown', 'chat'))
SELECT rule, us, sink FROM fired JOIN routes USING (rule)""",
    ),
    "alert_hold": with_(OUTCOMES + ",\n", hold("outcomes", "rule", "us", 7_200_000_000)),
    "subscriber_gauge": with_(
        EV,
        """, c AS (SELECT user_id AS gateway, us, event_id, CAST(CASE event_type WHEN 'signup' THEN 1 ELSE -1 END AS BIGINT) AS change
  FROM ev WHERE event_type IN ('signup', 'view'))
SELECT *, CAST(SUM(change) OVER (PARTITION BY gateway ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS subscribers FROM c""",
    ),
    "minimap_series": with_(
        EV,
        """SELECT us // 86400000000 * 86400000000 AS us,
  COALESCE(arg_max(cents, (ev.us, event_id)) FILTER (WHERE event_type = 'purchase'), -1) AS heap,
  COALESCE(arg_max(cents, (ev.us, event_id)) FILTER (WHERE event_type = 'error'), -1) AS blocked,
  CAST(COALESCE(SUM(cents) FILTER (WHERE event_type = 'view'), -1) AS BIGINT) AS gc
FROM ev WHERE event_type IN ('purchase', 'error', 'view') GROUP BY 1""",
    ),
    "heartbeat_lag": with_(
        EV,
        """, b AS (
  SELECT user_id AS id, us // 1000 AS ts_unix_ms, event_id, event_id % 100 AS goroutines, cents AS heap_bytes,
         CAST(ROUND(value) AS BIGINT) AS lag_ms FROM ev),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY ts_unix_ms DESC, event_id DESC) AS rn,
      MAX(lag_ms) OVER (PARTITION BY id) AS max_lag_ms FROM b)
SELECT id, ts_unix_ms, goroutines, heap_bytes, lag_ms, max_lag_ms FROM n WHERE rn = 1""",
    ),
    "flatten_order": with_(
        MERGED + ",\n" + flatten("flat", "tree", None), f"SELECT path, depth, cumulative, ROW_NUMBER() OVER (ORDER BY {FLATTEN_KEY} DESC) AS position FROM flat"
    ),
    "child_order": with_(MERGED, "SELECT path, value, ROW_NUMBER() OVER (ORDER BY depth > 0, string_split(path, ';')) AS position FROM tree"),
    "top_k": with_(
        MERGED + ",\n" + flatten("flat", "tree", None),
        """, n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY string_split(CASE path WHEN '' THEN chr(1114111) ELSE path || ';' || chr(1114111) END, ';') DESC) AS rank FROM flat)
SELECT rank, path, cumulative FROM n WHERE rank <= 10""",
    ),
    "top_k_hottest": with_(
        MERGED + ",\n" + flatten("flat", "tree", None),
        """, n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY cumulative DESC, string_split(CASE path WHEN '' THEN chr(1114111) ELSE path || ';' || chr(1114111) END, ';') DESC) AS rank FROM flat)
SELECT rank, path, cumulative FROM n WHERE rank <= 10""",
    ),
    "chronological": with_(FAST_CHUNKS, "SELECT *, ROW_NUMBER() OVER (ORDER BY seq) AS position FROM ring"),
    "span_annotations": with_(ANNOTATIONS, "SELECT event_id, gid, label FROM annotations"),
    "alert_payload": with_(
        EV,
        """, f AS (SELECT event_id, event_type || '/' || user_id AS rule, us, replace(props, '"', '\\"') AS msg FROM ev)
SELECT event_id,
  '{"msg":"' || msg || '","rule":"' || rule || '","ts":' || (us // 1000000) || '}' AS webhook,
  '{"icon_emoji":":fire:","text":"*alert* — ' || rule || '","username":"watcher"}' AS chat,
  '{"fields":{"description":"' || rule || '","issuetype":{"name":"Task"},"project":{"key":"OPS"},"summary":"alert – ' || rule || '"}}' AS issue
FROM f""",
    ),
    "metric_lookup": with_(METRICS, "SELECT us, CAST(click AS BIGINT) AS sum_known, CAST(0 AS BIGINT) AS by_missing FROM metrics"),
    "flame_window": """WITH s AS (
  SELECT epoch_us(l_shipdate) AS us, l_returnflag AS process_id, [c_mktsegment, o_orderpriority] AS stack, CAST(l_quantity AS BIGINT) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
w AS (
  SELECT us // 604800000000 * 604800000000 AS start_us, process_id, d, stack[1:d] AS prefix,
         CAST(SUM(CASE WHEN d > 0 THEN weight ELSE 0 END) AS BIGINT) AS value
  FROM s, (SELECT unnest(range(0, 3)) AS d) depths GROUP BY ALL)
SELECT start_us, process_id, array_to_string(prefix, ';') AS path, CASE WHEN d = 0 THEN 'root' ELSE prefix[d] END AS name, value
FROM w WHERE start_us + 604800000000 <= (SELECT MAX(us) FROM s) - 86400000000""",
    "stream_counters": with_(
        EV,
        """, r AS (
  SELECT user_id AS process_id, us, event_id, cents, event_id // 50 AS num_gc,
         LAG(cents) OVER w AS heap_before, LAG(event_id // 50) OVER w AS gc_before
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
c AS (SELECT process_id, us, event_id, unnest(range(gc_before, num_gc)) AS cycle FROM r),
p AS (SELECT *, (process_id * 7 + cycle % 256 * 13) % 11 * 1000 AS weight FROM c)
SELECT process_id, us, event_id, '(Heap)' AS path, cents - heap_before AS weight FROM r WHERE cents <> heap_before UNION ALL
SELECT process_id, us, event_id, '(GC)', weight FROM p WHERE weight <> 0""",
    ),
    "span_state": with_(
        EV,
        """SELECT user_id AS gid, MAX(us) AS us, arg_max(md5(CAST(event_id AS VARCHAR)), us) || ':0000000000000000' AS label
FROM ev WHERE event_type = 'signup' GROUP BY user_id""",
    ),
    "stream_alerts": with_(
        EV + """,
o AS (
  SELECT user_id AS process_id, us, event_id, 'large' AS rule, value > 20 AS holds, 86400000000 AS hold_us FROM ev UNION ALL
  SELECT user_id, us, event_id, 'small', NOT (value > 60), 172800000000 FROM ev),
""",
        hold("o", "rule, process_id", "us, event_id", "hold_us"),
    ),
    "stream_dedup_lru": with_(EV, DEDUP),
    "stream_trace_attach": with_(
        ANNOTATIONS,
        """, f AS (
  SELECT event_id, us, user_id, CAST(event_id AS VARCHAR) AS snapshot_id, 'goroutine-' || user_id AS name
  FROM ev WHERE event_type <> 'signup' AND us < (SELECT MAX(us) FROM ev) - 259200000000),
attached AS (
  SELECT f.snapshot_id, f.name, arg_max(a.label, (a.us, a.event_id)) AS label
  FROM f JOIN annotations a ON a.gid = f.user_id AND a.us <= f.us AND f.us - a.us <= 86400000000 GROUP BY ALL)
SELECT snapshot_id, name || ';_trace' AS path, label AS name, CAST(0 AS BIGINT) AS value FROM attached""",
    ),
    "stream_notify_within": with_(EV, "SELECT DISTINCT event_type || '/' || user_id AS rule, us // 86400000000 AS day FROM ev"),
    # a row is late if it is not newer than the watermark that the batch before began with
    "late_rows": with_(
        EV,
        """, b AS (
  SELECT us, CASE WHEN event_id % 10 = 0 THEN 3 ELSE (ts >= TIMESTAMP '2024-01-09')::INT + (ts >= TIMESTAMP '2024-01-16')::INT + (ts >= TIMESTAMP '2024-01-23')::INT END AS batch
  FROM ev),
w AS (SELECT batch, (SELECT MAX(us) // 1000 * 1000 - 172800000000 FROM b e WHERE e.batch < n.batch - 1) AS mark FROM (SELECT DISTINCT batch FROM b) n)
SELECT COUNT(*) AS rows_read, COUNT(*) FILTER (WHERE us <= mark) AS rows_late, COUNT(*) FILTER (WHERE mark IS NULL OR us > mark) AS rows_kept
FROM b JOIN w USING (batch)""",
    ),
    "sampler_to_exporter": with_(EV, "SELECT event_id, us, user_id, event_type, props AS payload FROM ev"),
    "flame_sliding": with_(
        LINE_SAMPLES,
        """, w AS (
  SELECT (us // 604800000000 - k) * 604800000000 AS start_us, process_id, d, stack[1:d] AS prefix, CAST(SUM(CASE WHEN d > 0 THEN weight ELSE 0 END) AS BIGINT) AS value
  FROM s, (SELECT unnest(range(0, 3)) AS d) depths, (SELECT unnest(range(0, 2)) AS k) slides GROUP BY ALL)
SELECT start_us, start_us + 1209600000000 AS end_us, process_id, array_to_string(prefix, ';') AS path, CASE WHEN d = 0 THEN 'root' ELSE prefix[d] END AS name, value
FROM w WHERE start_us + 1209600000000 <= (SELECT MAX(us) FROM s) - 86400000000""",
    ),
    "flame_session": with_(
        LINE_SAMPLES,
        """, p AS (
  SELECT us, process_id, d, stack[1:d] AS prefix, CASE WHEN d > 0 THEN weight ELSE 0 END AS weight
  FROM s, (SELECT unnest(range(0, 3)) AS d) depths),
g AS (
  SELECT *, CASE WHEN us - LAG(us) OVER (PARTITION BY process_id, prefix ORDER BY us) <= 129600000000 THEN 0 ELSE 1 END AS begins FROM p),
n AS (SELECT *, SUM(begins) OVER (PARTITION BY process_id, prefix ORDER BY us) AS nth FROM g),
w AS (
  SELECT MIN(us) AS start_us, MAX(us) + 129600000000 AS end_us, process_id, d, prefix, CAST(SUM(weight) AS BIGINT) AS value
  FROM n GROUP BY process_id, d, prefix, nth)
SELECT start_us, end_us, process_id, array_to_string(prefix, ';') AS path, CASE WHEN d = 0 THEN 'root' ELSE prefix[d] END AS name, value
FROM w WHERE end_us <= (SELECT MAX(us) FROM s) - 86400000000""",
    ),
    "seek_time": with_(
        CHUNKS,
        """, moments AS (SELECT CAST(day AS BIGINT) AS day, epoch_us(make_timestamp(2024, 1, day, 0, 0, 0.0)) AS moment FROM (VALUES (1), (9), (20), (31)) t(day))
SELECT seq, us, payload, day FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY day ORDER BY seq DESC) AS nth FROM chunks JOIN moments ON us <= moment) WHERE nth = 1""",
    ),
    "trace_to_tree": with_(
        TRACE
        + """,
parts AS (SELECT COUNT(*) AS n FROM part),
calls AS (SELECT event_id, type, val, j, (event_id * 7 + 13 * j) % n + 1 AS partkey FROM tr, parts, (SELECT unnest(range(0, 3)) AS j) depths),
samples AS (
  SELECT CAST(type AS VARCHAR) AS snapshot_id, list(p_brand || '.' || p_type ORDER BY j DESC) AS stack, val AS weight
  FROM calls JOIN part ON p_partkey = partkey GROUP BY event_id, type, val HAVING val <> 0),
nodes AS (
  SELECT snapshot_id, stack[1:d] AS prefix, d, CAST(SUM(CASE WHEN d > 0 THEN weight ELSE 0 END) AS BIGINT) AS value
  FROM samples, (SELECT unnest(range(0, 4)) AS d) depths WHERE d <= len(stack) GROUP BY ALL)""",
        "SELECT snapshot_id, array_to_string(prefix, ';') AS path, CASE WHEN d = 0 THEN 'root' ELSE prefix[d] END AS name, value FROM nodes",
    ),
    "stream_sinks": with_(
        EV,
        """SELECT '{"msg":"' || replace(props, '"', '\\"') || '","rule":"' || event_type || '","ts":' || (us // 1000000) || '}' AS payload
FROM ev""",
    ),
    "stream_retention": with_(
        EV, "SELECT event_id, us, props AS payload FROM ev WHERE us >= epoch_us(TIMESTAMP '2024-01-16')"
    ),
}
