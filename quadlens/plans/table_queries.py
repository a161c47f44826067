"""The same operators over the driver's tables, where the rows grow with the scale factor."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadlens.functions.stats import fraction, modes, rounded
from quadlens.operators import compare, mesh, scans, splits, strips, sweeps, wide_sheets
from quadlens.operators.graph import cut, shared_path
from quadlens.operators.nearest import nearest_faces
from quadlens.operators.ranks import exact_quantiles
from quadlens.plans import sql as S
from quadlens.sources import records, store

TABLE: dict[str, tuple] = {}
SEED = 20260731


def query(sql: str | None):
    def add(f):
        TABLE[f.__name__] = (f, sql)
        return f

    return add


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"SELECT l_returnflag AS flag, CAST(count(*) AS BIGINT) AS n, {', '.join(f'round(quantile_cont(l_extendedprice, {q}), 4) AS price_{n}' for n, q in (('p50', 0.5), ('p90', 0.9), ('p99', 0.99)))}, round(max(l_extendedprice), 4) AS price_max, round(avg(CASE WHEN l_discount <= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS within FROM lineitem GROUP BY l_returnflag")
def lineitem_percentiles(spark, sf_dir):
    """Pooled percentiles and tolerance fractions (A1-A3)."""
    li = cut(_read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").cast("double").alias("v"), "l_discount"))
    q = exact_quantiles(li, ["flag"], "v", {"price_p50": 0.5, "price_p90": 0.9, "price_p99": 0.99}).drop("n")
    own = li.groupBy("flag").agg(F.count("*").alias("n"), F.round(F.max("v"), 4).alias("price_max"), fraction(F.col("l_discount") <= 0.05).alias("within"))
    return rounded(own.join(q.select("flag", *[F.round(c, 4).alias(c) for c in ("price_p50", "price_p90", "price_p99")]), "flag"))


@query(S.with_("li AS (SELECT l_suppkey AS k, l_linenumber AS v FROM lineitem)", S.modal("m", "li", "k", "v"), last="SELECT k AS supplier, mode, round(share, 6) AS share, n FROM m"))
def lineitem_modes(spark, sf_dir):
    """Most frequent value with ties to the smallest, and its share (A4, A5)."""
    li = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), "l_linenumber")
    return rounded(modes(li, ["supplier"], "l_linenumber"))


@query("""SELECT kind, CAST(k AS INTEGER) AS rank, l_orderkey, l_linenumber, round(v, 2) AS v FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY s, l_orderkey, l_linenumber) AS k, CASE kind WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS o FROM
 (SELECT l_returnflag AS kind, l_orderkey, l_linenumber, l_extendedprice AS v, CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS s FROM lineitem)) ORDER BY k, o LIMIT 20""")
def lineitem_topk(spark, sf_dir):
    """Kinds taking turns in one list of the worst."""
    from pyspark.sql import Window

    li = _read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"))
    s = F.when(F.col("kind") == "R", -F.col("v")).otherwise(F.col("v"))
    k = F.row_number().over(Window.partitionBy("kind").orderBy(s, "l_orderkey", "l_linenumber"))
    turn = F.when(F.col("kind") == "A", 0).when(F.col("kind") == "N", 1).otherwise(2)
    top = li.withColumn("rank", k).where(F.col("rank") <= 20).orderBy("rank", turn).limit(20)
    return top.select("kind", "rank", "l_orderkey", "l_linenumber", F.round("v", 2).alias("v"))


@query(S.with_("q AS (SELECT l_orderkey AS o, l_linenumber AS c, l_quantity AS u FROM lineitem)", last="SELECT CAST(count(*) AS BIGINT) AS n_edges, CAST(count(*) FILTER (abs(b.u - a.u) <= 5) AS BIGINT) AS n_smooth, round(median(b.u - a.u), 6) AS drift FROM q a JOIN q b ON a.o = b.o AND a.c + 1 = b.c"))
def lineitem_adjacency(spark, sf_dir):
    """Neighbour edges along a grid direction and their drift."""
    q = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("c"), F.col("l_quantity").alias("u"))
    e = q.join(q.select("o", (F.col("c") - 1).alias("c"), F.col("u").alias("u2")), ["o", "c"]).withColumn("du", F.col("u2") - F.col("u"))
    return rounded(e.agg(F.count("*").alias("n_edges"), F.count_if(F.abs("du") <= 5).alias("n_smooth"), F.median("du").alias("drift")))


_PI = S.num(3.141592653589793)
_EVENTS = [
    f"ev AS (SELECT user_id, event_id, value - {S.T} * floor((value + {_PI}) / {S.T}) AS theta FROM events)",
    "sd AS (SELECT *, theta - lag(theta) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM ev)",
    f"sm AS (SELECT *, (step + {_PI}) - {S.T} * floor((step + {_PI}) / {S.T}) - {_PI} AS m0 FROM sd)",
    f"sx AS (SELECT *, CASE WHEN step IS NULL OR abs(step) < {_PI} THEN 0e0 ELSE (CASE WHEN m0 = -{_PI} AND step > 0 THEN {_PI} ELSE m0 END) - step END AS fix FROM sm)",
    f"su AS (SELECT *, (theta + sum(fix) OVER (PARTITION BY user_id ORDER BY event_id)) / {S.T} AS turns FROM sx)",
]


def _turns(spark, sf_dir):
    ev = _read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") - strips.TURN * F.floor((F.col("value") + 3.141592653589793) / strips.TURN)).alias("theta"))
    return strips.with_turns(ev, ["user_id"], "event_id")


@query(S.with_(*_EVENTS, last="SELECT user_id, event_id, round(turns, 5) AS turns FROM su"))
def events_unwrap(spark, sf_dir):
    """Azimuth unwrapped along each user's events."""
    return rounded(_turns(spark, sf_dir).select("user_id", "event_id", "turns"), 5)


@query(S.with_(*_EVENTS, "m AS (SELECT user_id, median(turns) AS mid FROM su GROUP BY user_id)", last="SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (abs(turns - mid) < 0.5) AS BIGINT) AS n_agree, round(max(abs(turns - mid)), 5) AS spread FROM su JOIN m USING (user_id) GROUP BY user_id"))
def events_offsets(spark, sf_dir):
    """Offsets from each strip's own median."""
    t = _turns(spark, sf_dir)
    j = t.join(t.groupBy("user_id").agg(F.median("turns").alias("mid")), "user_id").withColumn("off", F.abs(F.col("turns") - F.col("mid")))
    return rounded(j.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("off") < 0.5).alias("n_agree"), F.max("off").alias("spread")), 5)


#: Part names given suffixes as derived exports have them.
_NAME = "concat(p_name, CASE WHEN p_partkey % 4 = 0 THEN '_v2_flatboi' WHEN p_partkey % 4 = 1 THEN '_region_3' WHEN p_partkey % 4 = 2 THEN '_copy_sel_a_1' ELSE '' END)"


def _sql_family_cte(src: str, name: str, rounds: int = 4) -> list[str]:
    out, prev = [], src
    for i in range(rounds * len(splits.SUFFIXES)):
        s = splits.SUFFIXES[i % len(splits.SUFFIXES)]
        out.append(f"fk{i} AS (SELECT * EXCLUDE ({name}), coalesce(nullif(regexp_replace({name}, '{s}', ''), ''), {name}) AS {name} FROM {prev})")
        prev = f"fk{i}"
    return out


@query(S.with_(f"nm AS (SELECT p_partkey, {_NAME} AS full_name, {_NAME} AS family FROM part)", *_sql_family_cte("nm", "family"), last="SELECT p_partkey, full_name, family FROM fk15"))
def family_keys(spark, sf_dir):
    """Names without derived-export suffixes."""
    return _read(spark, sf_dir, "part").select("p_partkey", F.expr(_NAME).alias("full_name")).withColumn("family", splits.family_key(F.col("full_name")))


_GEO = r"sha256(lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n]+', ' ', 'g'))))"
_ITEMS = [
    f"it AS (SELECT doc_id, source || '_' || lang AS family0, 'd' || CAST(doc_id AS VARCHAR) AS name, sha256(coalesce(text, '')) AS content_hash, {_GEO} AS geometry_hash, CAST(n_chars AS DOUBLE) AS z FROM documents)",
    "itf AS (SELECT doc_id, name, name AS family, content_hash, geometry_hash, z FROM it)",
    "roots AS (SELECT geometry_hash, min(family) AS root FROM itf GROUP BY geometry_hash)",
    "itr AS (SELECT itf.*, root FROM itf JOIN roots USING (geometry_hash))",
]


def _items(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    geo = F.sha2(F.lower(F.trim(F.regexp_replace(text, "[ \\t\\n]+", " "))), 256)
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return d.select("doc_id", name.alias("name"), name.alias("family"), F.sha2(text, 256).alias("content_hash"), geo.alias("geometry_hash"), F.col("n_chars").cast("double").alias("z"))


@query(S.with_(*_ITEMS, last="SELECT doc_id, root FROM itr"))
def docs_twins(spark, sf_dir):
    """Items that share a geometry become one family."""
    return splits.merged_families(_items(spark, sf_dir)).select("doc_id", "root")


_SPLIT = [
    *_ITEMS, "fam AS (SELECT root, avg(z) AS z FROM itr GROUP BY root)", "num AS (SELECT *, row_number() OVER (ORDER BY z, root) - 1 AS n, count(*) OVER () AS total FROM fam)",
    "blk AS (SELECT *, greatest(1, CAST(round_even(total * 0.2, 0) AS BIGINT)) AS blocks FROM num)",
    "bnd AS (SELECT b, CAST(round_even(b * (total / blocks), 0) AS BIGINT) AS lo, CAST(round_even((b + 1) * (total / blocks), 0) AS BIGINT) AS hi FROM (SELECT DISTINCT total, blocks FROM blk) t, range(1000000) r(b) WHERE b < blocks)",
    "inb AS (SELECT root, b FROM blk JOIN bnd ON n >= lo AND n < hi)",
    f"pk AS (SELECT root, b, row_number() OVER (PARTITION BY b ORDER BY sha256('{SEED}|' || root)) = 1 AS held FROM inb)",
    "sp AS (SELECT itr.*, b AS block, CASE WHEN held THEN 'heldout' ELSE 'fit' END AS side FROM itr JOIN pk USING (root))",
]


def _split(spark, sf_dir):
    return splits.z_stratified(splits.merged_families(_items(spark, sf_dir)), 0.2, SEED)


@query(S.with_(*_SPLIT, last="SELECT doc_id, root, block, side FROM sp"))
def docs_split(spark, sf_dir):
    """Family-grouped, z-stratified split."""
    return _split(spark, sf_dir).select("doc_id", "root", "block", "side")


@query(S.with_(*_SPLIT, last="SELECT side, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT root) AS BIGINT) AS n_families, CAST((SELECT count(*) FROM (SELECT geometry_hash FROM sp WHERE side = 'fit' INTERSECT SELECT geometry_hash FROM sp WHERE side = 'heldout')) AS BIGINT) AS n_crossing FROM sp GROUP BY side"))
def split_self_check(spark, sf_dir):
    """Sizes of the sides, and the geometries on both: none."""
    s = cut(_split(spark, sf_dir))
    return s.groupBy("side").agg(F.count("*").alias("n"), F.count_distinct("root").alias("n_families")).crossJoin(splits.crossing(s).agg(F.count("*").alias("n_crossing")))


_AUDIT = [*_ITEMS, "held AS (SELECT DISTINCT geometry_hash FROM itf WHERE doc_id % 5 = 0)", "ins AS (SELECT * FROM itf WHERE doc_id % 5 <> 0)"]


@query(S.with_(*_AUDIT, last="SELECT doc_id, geometry_hash FROM ins WHERE geometry_hash IN (SELECT geometry_hash FROM held)"))
def audit_semi(spark, sf_dir):
    """Inputs whose geometry is held out."""
    items = _items(spark, sf_dir)
    return splits.audit_inputs(items.where("doc_id % 5 <> 0"), items.where("doc_id % 5 = 0")).select("doc_id", "geometry_hash")


@query(S.with_(*_AUDIT, last="SELECT doc_id, content_hash FROM ins WHERE geometry_hash NOT IN (SELECT geometry_hash FROM held)"))
def audit_anti(spark, sf_dir):
    """Scored items whose geometry is not held out."""
    items = _items(spark, sf_dir)
    return splits.audit_scored(items.where("doc_id % 5 <> 0"), items.where("doc_id % 5 = 0")).select("doc_id", "content_hash")


@query("""SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (quality = CAST(n_chars >= 200 AS INTEGER)) AS BIGINT) AS n_equal, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS n_good, round(avg(CASE WHEN quality = CAST(n_chars >= 200 AS INTEGER) THEN 1.0 ELSE 0.0 END), 6) AS concordance FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def verdict_concordance(spark, sf_dir):
    """A rule's verdicts against external ones."""
    j = _read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(_read(spark, sf_dir, "labels"), "doc_id")
    same = F.col("quality") == (F.col("n_chars") >= 200).cast("int")
    return rounded(j.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(same).alias("n_equal"), F.count_if(F.col("quality") == 1).alias("n_good"), fraction(same).alias("concordance")))


@query("""SELECT lang, last.quality, CAST(count(*) AS BIGINT) AS n FROM documents JOIN (SELECT doc_id % 50 AS name, arg_max(quality, doc_id) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY ALL) last ON documents.doc_id % 50 = last.name GROUP BY ALL""")
def last_verdicts(spark, sf_dir):
    """Verdicts joined by a name that repeats: the last one counts."""
    named = _read(spark, sf_dir, "labels").where("quality IS NOT NULL").select((F.col("doc_id") % 50).alias("name"), "doc_id", "quality")
    docs = _read(spark, sf_dir, "documents").select("lang", (F.col("doc_id") % 50).alias("name"))
    return docs.join(compare.last_wins(named, "name", "doc_id").drop("doc_id"), "name").groupBy("lang", "quality").agg(F.count("*").alias("n"))


_PAIRED = """SELECT l_suppkey AS item, CAST(count(*) AS DOUBLE) AS weight, avg(l_extendedprice) FILTER (l_linestatus = 'F') AS a, avg(l_extendedprice) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY l_suppkey HAVING a IS NOT NULL AND b IS NOT NULL"""
_DRAWS = 20_000


@query(f"""WITH p AS ({_PAIRED}), n AS (SELECT *, row_number() OVER (ORDER BY item) - 1 AS k, count(*) OVER () AS total FROM p)
SELECT CAST(count(*) AS BIGINT) AS n_items, round(sum(a * weight) / sum(weight), 3) AS a, round(sum(b * weight) / sum(weight), 3) AS b, round(sum(b * weight) / sum(weight) - sum(a * weight) / sum(weight), 3) AS delta FROM n""")
def paired_means(spark, sf_dir):
    """Weighted means of paired items and their difference."""
    p = _paired(spark, sf_dir)
    mean = lambda c: F.sum(F.col(c) * F.col("weight")) / F.sum("weight")
    return rounded(p.agg(F.count("*").alias("n_items"), mean("a").alias("a"), mean("b").alias("b"), (mean("b") - mean("a")).alias("delta")), 3)


def _paired(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem")
    mean = lambda x: F.avg(F.when(F.col("l_linestatus") == x, F.col("l_extendedprice")))
    return li.groupBy(F.col("l_suppkey").alias("item")).agg(F.count("*").cast("double").alias("weight"), mean("F").alias("a"), mean("O").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


@query(None)
def paired_bootstrap(spark, sf_dir):
    """The same with a 95 % interval over 20,000 resamplings of the suppliers, each side by weights of its own."""
    li = _read(spark, sf_dir, "lineitem")
    of = lambda x, c: F.when(F.col("l_linestatus") == x, F.col(c))
    p = li.groupBy(F.col("l_suppkey").alias("item")).agg(F.count(of("F", "l_suppkey")).alias("weight"), F.count(of("O", "l_suppkey")).alias("weight_b"), F.avg(of("F", "l_extendedprice")).alias("a"), F.avg(of("O", "l_extendedprice")).alias("b"))
    return rounded(compare.paired_bootstrap(p, _DRAWS, SEED), 3)


_BY_NATION = """SELECT c_nationkey AS item, CAST(count(*) AS DOUBLE) AS weight, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL"""


@query(f"""WITH p AS ({_BY_NATION}), n AS (SELECT *, row_number() OVER (ORDER BY item) - 1 AS k, count(*) OVER () AS total FROM p),
slots AS (SELECT i // total AS draw, i % total AS slot, total FROM (SELECT DISTINCT total FROM n), (SELECT unnest(range({_DRAWS} * (SELECT count(*) FROM p))) AS i)),
taken AS (SELECT draw, CAST(concat('0x', substr(md5(concat('{SEED}|', draw, '|', slot)), 1, 8)) AS BIGINT) % total AS k, count(*) AS times FROM slots GROUP BY ALL),
each AS (SELECT draw, sum(times * weight * b) / sum(times * weight) - sum(times * weight * a) / sum(times * weight) AS d FROM taken JOIN n USING (k) GROUP BY draw),
ends AS (SELECT quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM each), whole AS (SELECT sum(a * weight) / sum(weight) AS a, sum(b * weight) / sum(weight) AS b FROM p)
SELECT round(a, 3) AS a, round(b, 3) AS b, round(b - a, 3) AS delta, round(lo, 3) AS lo, round(hi, 3) AS hi, (lo > 0) = (hi > 0) AS excludes_zero FROM whole, ends""")
def slot_bootstrap(spark, sf_dir):
    """The interval over few items, nations, by a hash per draw and slot."""
    o = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    mean = lambda x: F.avg(F.when(F.col("o_orderstatus") == x, F.col("o_totalprice")))
    p = o.groupBy(F.col("c_nationkey").alias("item")).agg(F.count("*").cast("double").alias("weight"), mean("F").alias("a"), mean("O").alias("b"))
    return rounded(compare.slot_bootstrap(p, _DRAWS, SEED), 3)


_ASOF = [
    "pu AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL)",
    "vi AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'view')",
    "lo AS (SELECT vi.*, p.t AS t0, p.v AS v0 FROM vi ASOF LEFT JOIN pu p ON vi.user_id = p.user_id AND vi.t >= p.t)",
    "both_ AS (SELECT lo.*, p.t AS t1, p.v AS v1 FROM lo ASOF LEFT JOIN pu p ON lo.user_id = p.user_id AND lo.t <= p.t)",
]


@query(S.with_(*_ASOF, last="SELECT event_id, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (t - t0) / (t1 - t0) * (v1 - v0) END, 4) AS value FROM both_"))
def events_interpolated(spark, sf_dir):
    """Each user's purchase values, interpolated at the times of the user's views; a user may hold any share of either."""
    ev = _read(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    known = ev.where("event_type = 'purchase'").groupBy("user_id", "t").agg(F.max("value").alias("value"))
    found = scans.interpolated(ev.where("event_type = 'view'").select("event_id", "user_id", "t"), known, ["user_id"], "t", "value")
    return rounded(found.select("event_id", "value"), 4)


_FLOOR = [
    "d AS (SELECT abs(l_extendedprice / l_quantity - 1500) AS d, l_returnflag AS f, l_orderkey % 2 AS half, l_quantity AS qty FROM lineitem)",
    "th AS (SELECT DISTINCT round(p_retailprice - 900, 2) AS t FROM part)",
    "u AS (SELECT d AS t, 0 AS kind, CAST(f <> 'R' AND half = 0 AS INT) AS a, CAST(f <> 'R' AND half = 1 AS INT) AS b, CAST(f = 'R' AND qty > 25 AS INT) AS s FROM d UNION ALL SELECT t, 1, 0, 0, 0 FROM th)",
    "run AS (SELECT t, kind, sum(a) OVER w AS a, sum(b) OVER w AS b, sum(s) OVER w AS s FROM u WINDOW w AS (ORDER BY t, kind RANGE UNBOUNDED PRECEDING))",
    "cu AS (SELECT t, a / max(a) OVER () AS a, b / max(b) OVER () AS b, s / max(s) OVER () AS s FROM run WHERE kind = 1)",
    "band AS (SELECT max(abs(a - b)) AS band, count(*) AS n FROM cu)",
    "bey AS (SELECT t, least(abs(s - a), abs(s - b)) AS gap FROM cu, band WHERE least(abs(s - a), abs(s - b)) > band)",
]


@query(S.with_(*_FLOOR, last="SELECT CAST(n AS BIGINT) AS n_thresholds, round(band, 6) AS band, (SELECT round(min(t), 2) FROM bey) AS floor, (SELECT round(arg_min(gap, t), 6) FROM bey) AS at_floor FROM band"))
def lineitem_floor(spark, sf_dir):
    """The least of the parts' prices, as thresholds, at which returned items of more than 25 leave the band of two null halves."""
    li = _read(spark, sf_dir, "lineitem").select(F.abs(F.col("l_extendedprice") / F.col("l_quantity") - 1500).alias("d"), "l_returnflag", (F.col("l_orderkey") % 2).alias("half"), "l_quantity")
    thresholds = _read(spark, sf_dir, "part").select(F.round(F.col("p_retailprice") - 900, 2).alias("t"))
    groups = {"a": "l_returnflag <> 'R' AND half = 0", "b": "l_returnflag <> 'R' AND half = 1", "s": "l_returnflag = 'R' AND l_quantity > 25"}
    return rounded(sweeps.floor_of(sweeps.within_each(li, "d", thresholds, "t", groups), "t", ("a", "b"), "s"))


_GRID = ["pts AS (SELECT l_orderkey // 25 AS patch, l_orderkey % 25 AS r, l_linenumber AS c, max(CAST(l_quantity AS DOUBLE)) / 4 AS u FROM lineitem GROUP BY ALL)"]


@query(S.with_(*_GRID, *S.sheets(), last="SELECT patch, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(sheet // 100000 AS INTEGER) AS sheet_row, CAST(sheet % 100000 AS INTEGER) AS sheet_col FROM sheet"))
def lineitem_sheets(spark, sf_dir):
    """Continuous sheets over grids of orders and lines, many grids in a task."""
    k = F.col("l_orderkey")
    points = _read(spark, sf_dir, "lineitem").groupBy(F.floor(k / 25).alias("patch"), (k % 25).cast("int").alias("row"), F.col("l_linenumber").alias("col")).agg((F.max(F.col("l_quantity").cast("double")) / 4).alias("u"))
    return wide_sheets.wide_sheets(points, ["patch"]).drop("u")


@query("SELECT concat('seed', seed) AS scenario, lang, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (sha256(concat(seed, '|', doc_id)) < '4') AS BIGINT) AS n_held FROM documents, range(3) s(seed) GROUP BY ALL")
def scenario_store(spark, sf_dir):
    """Splits by three seeds kept as scenarios of one store; one is written twice, with other rows first, and one after the others."""
    docs, path = _read(spark, sf_dir, "documents").select("doc_id", "lang"), shared_path(spark, "store")

    def split(seed):
        held = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")), 256) < "4"
        return docs.withColumn("held", held).withColumn("scenario", F.lit(f"seed{seed}"))

    store.save(split(0).unionByName(split(1)), path, "scenario")
    store.save(split(9).withColumn("scenario", F.lit("seed1")), path, "scenario")
    store.save(split(1), path, "scenario")
    wanted = spark.createDataFrame([(f"seed{k}",) for k in range(3)], "scenario string")
    for r in store.missing(spark, path, wanted).collect():  # a row a scenario
        store.save(split(int(r["scenario"][4:])), path, "scenario")
    return store.load(spark, path).groupBy("scenario", "lang").agg(F.count("*").alias("n"), F.count_if("held").alias("n_held"))


_DAMAGED = "CASE event_id % 29 WHEN 3 THEN substr(props, 1, 4) WHEN 5 THEN '[1, 2]' WHEN 7 THEN NULL WHEN 11 THEN concat('{\"k\": \"', user_id, 'x\"}') ELSE props END"


@query(f"""WITH d AS (SELECT event_id, {_DAMAGED} AS props FROM events), j AS (SELECT *, CASE WHEN json_valid(props) THEN props END AS j FROM d)
SELECT event_id, CASE WHEN json_type(j, '$.k') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract(j, '$.k') AS BIGINT) END AS k,
 CASE WHEN props IS NULL THEN 'missing' WHEN j IS NULL OR json_type(j) <> 'OBJECT' OR json_type(j, '$.k') NOT IN ('BIGINT', 'UBIGINT') THEN 'malformed' END AS error FROM j""")
def props_records(spark, sf_dir):
    """Nested JSON read record by record: what is good, and what is wrong with the rest."""
    ev = _read(spark, sf_dir, "events").select("event_id", F.expr(_DAMAGED).alias("props"))
    good, errors = records.parsed(ev, "props", "k long")
    return good.select("event_id", "k", F.lit(None).cast("string").alias("error")).unionByName(errors.select("event_id", F.lit(None).cast("long").alias("k"), "error"))


_EMB = [
    "ev AS (SELECT 1 AS winding, vec_id // 25 AS r, vec_id % 25 AS c, CAST(CAST(embedding[1] AS DOUBLE) * 10 AS FLOAT) AS z, CAST(CAST(embedding[2] AS DOUBLE) * 10 AS FLOAT) AS y, CAST(CAST(embedding[3] AS DOUBLE) * 10 AS FLOAT) AS x, true AS valid FROM embeddings)",
    "ep AS (SELECT vec_id, CAST(embedding[4] AS DOUBLE) * 10 AS pz, CAST(embedding[5] AS DOUBLE) * 10 AS py, CAST(embedding[6] AS DOUBLE) * 10 AS px FROM embeddings)",
]


@query(S.with_(*_EMB, *S.faces("f", "ev"), *S.nearest("near", "ep", ["vec_id"], "f"), last="SELECT vec_id, CAST(fr AS INTEGER) AS face_row, CAST(fc AS INTEGER) AS face_col, round(dist, 5) AS dist FROM near"))
def emb_nearest(spark, sf_dir):
    """The nearest face of a surface woven from the vectors, for a point of every vector; both grow with the table."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", *[(F.col("embedding")[i].cast("double") * 10).alias(f"e{i}") for i in range(6)])
    grid = e.select(F.lit(1).alias("winding"), F.floor(F.col("vec_id") / 25).cast("int").alias("row"), (F.col("vec_id") % 25).cast("int").alias("col"), *[F.col(f"e{i}").cast("float").alias(a) for i, a in enumerate("zyx")], F.lit(True).alias("valid"))
    points = e.select("vec_id", *[F.col(f"e{i + 3}").alias(f"p{a}") for i, a in enumerate("zyx")])
    return nearest_faces(points, mesh.faces(grid), ["vec_id"]).select("vec_id", "face_row", "face_col", F.round("dist", 5).alias("dist"))


_BY_LABEL = [
    "en AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings)",
    "ev AS (SELECT label AS winding, k // 5 AS r, k % 5 AS c, CAST(CAST(embedding[1] AS DOUBLE) * 10 + 5000 * label AS FLOAT) AS z, CAST(CAST(embedding[2] AS DOUBLE) * 10 AS FLOAT) AS y, CAST(CAST(embedding[3] AS DOUBLE) * 10 AS FLOAT) AS x, true AS valid FROM en)",
    "ep AS (SELECT vec_id, label AS winding, CAST(embedding[4] AS DOUBLE) * 10 AS pz, CAST(embedding[5] AS DOUBLE) * 10 AS py, CAST(embedding[6] AS DOUBLE) * 10 AS px FROM embeddings)",
]


@query(S.with_(*_BY_LABEL, *S.faces("f", "ev"), *S.nearest("near", "ep", ["vec_id", "winding"], "f", within="winding"), last="SELECT vec_id, k_label AS label, CAST(fr AS INTEGER) AS face_row, CAST(fc AS INTEGER) AS face_col, round(dist, 4) AS dist FROM (SELECT *, winding AS k_label FROM near)"))
def emb_nearest_by_label(spark, sf_dir):
    """Each label's vectors woven into a surface of its own, far apart in z: the nearest face of its own label for a point of every vector."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "label", *[(F.col("embedding")[i].cast("double") * 10).alias(f"e{i}") for i in range(6)])
    n = splits.numbered(e, "label", "vec_id")
    first = n.groupBy("label").agg(F.min("n").alias("first"))
    k = F.col("n") - F.col("first")
    grid = n.join(F.broadcast(first), "label").select(  # as many rows as labels
        "label", F.lit(0).alias("winding"), F.floor(k / 5).cast("int").alias("row"), (k % 5).cast("int").alias("col"),
        (F.col("e0") + 5000 * F.col("label")).cast("float").alias("z"), F.col("e1").cast("float").alias("y"), F.col("e2").cast("float").alias("x"), F.lit(True).alias("valid"))
    points = e.select("vec_id", "label", *[F.col(f"e{i + 3}").alias(f"p{a}") for i, a in enumerate("zyx")])
    near = nearest_faces(points, mesh.faces(grid, ["label"]), ["vec_id"], within=["label"])
    return near.select("vec_id", "label", "face_row", "face_col", F.round("dist", 4).alias("dist"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING min(l_quantity) - 2 <= 10 AND max(l_quantity) + 2 >= 30)""")
def interval_overlap(spark, sf_dir):
    """Items whose extent overlaps a window with a margin."""
    ext = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    hit = ext.where((F.col("lo") - 2 <= 10) & (F.col("hi") + 2 >= 30))
    return _read(spark, sf_dir, "orders").join(hit, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("""SELECT CAST(user_id AS BIGINT) AS user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 1""")
def densest_group(spark, sf_dir):
    """The group with most evidence, ties to the smallest."""
    return _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(1)
