"""Events and the features built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import dc, ml
from tickloom.operators.joins import zip_thresholds
from tickloom.operators.timeline import Timeline, row_index
from tickloom.operators.windows import union_all
from tickloom.session import cut_lineage
from tickloom.workload.inputs import SPAN, THRESHOLDS, TICKS, dc_sql
from tickloom.workload.registry import Tables, query

ONE = 0.3
ONE_SQL = dc_sql([(ONE, ONE)])


def events_of(t: Tables, thresholds=THRESHOLDS) -> DataFrame:
    return dc.dc_events(t.ticks, thresholds, order="event_id", span=SPAN)


def one(t: Tables) -> DataFrame:
    """Events of one threshold, written out once because several branches read them."""
    return cut_lineage(events_of(t, [ONE]))


FEATS_SQL = f"""{ONE_SQL},
pdcc AS (SELECT * FROM dc WHERE event_type IN ('PDCC_Down', 'PDCC2_UP')),
feats AS (
  SELECT t.symbol, t.ts, t.event_id, t.price, p.end_time AS anchor_time, p.end_price AS anchor_price,
    CASE p.event_type WHEN 'PDCC2_UP' THEN 'up' WHEN 'PDCC_Down' THEN 'down' ELSE 'none' END AS regime,
    (coalesce(p.event_type = 'PDCC2_UP' AND p.end_time = t.ts, false))::INT AS "PDCC2_UP",
    (coalesce(p.event_type = 'PDCC_Down' AND p.end_time = t.ts, false))::INT AS "PDCC_Down",
    (coalesce(p.event_type = 'PDCC2_UP', false))::INT AS regime_up,
    (coalesce(p.event_type = 'PDCC_Down', false))::INT AS regime_down,
    CASE WHEN p.event_type = 'PDCC2_UP' THEN (t.price - p.end_price) / p.end_price * 100 ELSE 0 END AS "OSV_Up",
    CASE WHEN p.event_type = 'PDCC_Down' THEN (p.end_price - t.price) / p.end_price * 100 ELSE 0 END AS "OSV_Down"
  FROM ticks t ASOF LEFT JOIN pdcc p ON t.symbol = p.symbol AND t.ts >= p.end_time),
full_feats AS (SELECT *, greatest("OSV_Up", 0) AS "OSV_Up_clamped", greatest("OSV_Down", 0) AS "OSV_Down_clamped" FROM feats)"""


@query(
    "D1_dc_events",
    f"WITH RECURSIVE {dc_sql()} SELECT * FROM dc",
    "start_price end_price threshold_down threshold_up max_osv",
)
def _(t: Tables):
    return events_of(t)


@query(
    "D1_bad_prices",
    f"WITH RECURSIVE {dc_sql()} SELECT * FROM dc",
    "start_price end_price threshold_down threshold_up max_osv",
)
def _(t: Tables):
    """Every tick has a broken twin at the same moment; the events are those of the sound ticks."""
    k = F.col("event_id") % 5
    inf = float("inf")
    broken = F.when(k == 0, float("nan")).when(k == 1, 0.0).when(k == 2, -1.0).when(k == 3, inf)
    twins = t.ticks.withColumn("price", broken)
    return dc.dc_events(t.ticks.unionByName(twins), THRESHOLDS, order="event_id", span=SPAN)


@query(
    "D1_bad_ticks",
    "SELECT CASE WHEN event_id % 5 = 4 THEN 'no price' ELSE 'bad price' END AS error, count(*) AS n FROM events WHERE event_id % 5 <> 3 GROUP BY 1",
)
def _(t: Tables):
    k = F.col("event_id") % 5
    broken = F.when(k == 0, float("nan")).when(k == 1, 0.0).when(k == 2, -1.0).when(k == 3, 1.0)
    return dc.bad_ticks(t.ticks.withColumn("price", broken)).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query(
    "D1_dc_events_asymmetric",
    f"WITH RECURSIVE {dc_sql([(0.2, 0.4)])} SELECT * FROM dc",
    "start_price end_price threshold_down threshold_up max_osv",
)
def _(t: Tables):
    return events_of(t, ["0.2:0.4"])


@query(
    "D2_dc_annotate",
    f"""WITH RECURSIVE {ONE_SQL},
marks AS (SELECT symbol, end_time AS ts,
    coalesce(max(event_type) FILTER (event_type LIKE 'PDCC%'), max(event_type)) AS event
  FROM dc GROUP BY ALL)
SELECT ticks.*, event, CASE event WHEN 'PDCC_Down' THEN 'Downward Start' WHEN 'OSV_Down' THEN 'Downward Update'
  WHEN 'PDCC2_UP' THEN 'Upward Start' WHEN 'OSV_Up' THEN 'Upward Update' END AS event_label
FROM ticks LEFT JOIN marks USING (symbol, ts)""",
    "price",
)
def _(t: Tables):
    return dc.dc_annotate(t.ticks, events_of(t, [ONE]))


@query(
    "D4_dc_features",
    f"WITH RECURSIVE {FEATS_SQL} SELECT * FROM full_feats",
    "price anchor_price OSV_Up OSV_Down OSV_Up_clamped OSV_Down_clamped",
)
def _(t: Tables):
    return dc.dc_features(t.ticks, one(t), ONE, order="event_id", span=SPAN)


EV_FEATS = """SELECT symbol, start_time, end_time, start_price, end_price, event_type, threshold_down,
  threshold_up, max_osv, {up}::INT AS "PDCC2_UP", {down}::INT AS "PDCC_Down",
  CASE WHEN event_type = 'OSV_Up' THEN abs((start_price - end_price) / start_price * 100) ELSE 0 END AS "OSV_Up",
  CASE WHEN event_type = 'OSV_Down' THEN abs((start_price - end_price) / start_price * 100) ELSE 0 END AS "OSV_Down"
  {flags} FROM dc"""
EV1 = EV_FEATS.format(
    up="(event_type IN ('PDCC2_UP', 'OSV_Up'))", down="(event_type IN ('PDCC_Down', 'OSV_Down'))", flags=""
)
EV2 = EV_FEATS.format(
    up="(event_type = 'PDCC2_UP')", down="(event_type = 'PDCC_Down')",
    flags=""", (event_type = 'OSV_Up')::INT AS "OSV_Up_flag", (event_type = 'OSV_Down')::INT AS "OSV_Down_flag" """,
)
EV_DOUBLES = "start_price end_price threshold_down threshold_up max_osv OSV_Up OSV_Down"


@query("D5_dc_event_features_v1", f"WITH RECURSIVE {ONE_SQL} {EV1}", EV_DOUBLES)
def _(t: Tables):
    return dc.dc_event_features(events_of(t, [ONE]), ONE, 1)


@query("D5_dc_event_features_v2", f"WITH RECURSIVE {ONE_SQL} {EV2}", EV_DOUBLES)
def _(t: Tables):
    return dc.dc_event_features(events_of(t, [ONE]), ONE, 2)


def _inside_sql(ev: str, flags: str, order: str, after: str) -> str:
    return f"""{ONE_SQL}, ev AS ({ev}),
picked AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY symbol, start_time
    ORDER BY end_time DESC, "OSV_Up" DESC, "OSV_Down" DESC, {order}) = 1),
joined AS (SELECT t.*, p.start_time, p.end_time, p.start_price, {flags}
  FROM ticks t ASOF JOIN picked p ON t.symbol = p.symbol AND t.ts >= p.start_time
  WHERE t.ts {after} p.start_time AND t.ts < p.end_time)"""


@query(
    "D6_dc_tick_features_v1",
    f"""WITH RECURSIVE {_inside_sql(EV1, 'p."PDCC2_UP", p."PDCC_Down", p."OSV_Up" AS u, p."OSV_Down" AS d', '"PDCC2_UP" DESC, "PDCC_Down" DESC', '>')}
SELECT symbol, ts, event_id, price, start_time, end_time, start_price, "PDCC2_UP", "PDCC_Down",
  CASE WHEN "PDCC2_UP" = 1 THEN abs((price - start_price) / start_price * 100) ELSE u END AS "OSV_Up",
  CASE WHEN "PDCC_Down" = 1 THEN abs((price - start_price) / start_price * 100) ELSE d END AS "OSV_Down" FROM joined""",
    "price start_price OSV_Up OSV_Down",
)
def _(t: Tables):
    return dc.dc_tick_features(t.ticks, one(t), ONE, 1, order="event_id", span=SPAN)


@query(
    "D6_dc_tick_features_v2",
    f"""WITH RECURSIVE {_inside_sql(EV2, 'p."PDCC2_UP", p."PDCC_Down", p."OSV_Up_flag" AS uf, p."OSV_Down_flag" AS df', '"PDCC2_UP" DESC, "PDCC_Down" DESC, "OSV_Up_flag" DESC, "OSV_Down_flag" DESC', '>=')},
spread AS (SELECT *, max(uf) OVER g AS "OSV_Up_flag", max(df) OVER g AS "OSV_Down_flag" FROM joined
  WINDOW g AS (PARTITION BY symbol, start_time))
SELECT symbol, ts, event_id, price, start_time, end_time, start_price, "PDCC2_UP", "PDCC_Down",
  CASE WHEN "OSV_Up_flag" = 1 THEN abs((price - start_price) / start_price * 100) ELSE 0 END AS "OSV_Up",
  CASE WHEN "OSV_Down_flag" = 1 THEN abs((price - start_price) / start_price * 100) ELSE 0 END AS "OSV_Down",
  "OSV_Up_flag", "OSV_Down_flag" FROM spread""",
    "price start_price OSV_Up OSV_Down",
)
def _(t: Tables):
    return dc.dc_tick_features(t.ticks, one(t), ONE, 2, order="event_id", span=SPAN)


@query(
    "A9_regime_stats",
    f"""WITH RECURSIVE {FEATS_SQL},
numbered AS (SELECT *, sum("PDCC2_UP" + "PDCC_Down") OVER (PARTITION BY symbol ORDER BY ts, event_id) AS run FROM feats),
runs AS (SELECT symbol, run, count(*) AS len, max("PDCC2_UP") AS up FROM numbered WHERE run > 0 GROUP BY ALL)
SELECT symbol, avg(len) FILTER (up = 1) AS avg_ticks_up_regime, stddev_samp(len) FILTER (up = 1) AS std_ticks_up_regime,
  count(*) FILTER (up = 1) AS num_up_regimes, avg(len) FILTER (up = 0) AS avg_ticks_down_regime,
  stddev_samp(len) FILTER (up = 0) AS std_ticks_down_regime, count(*) FILTER (up = 0) AS num_down_regimes
FROM runs GROUP BY symbol""",
    "avg_ticks_up_regime std_ticks_up_regime avg_ticks_down_regime std_ticks_down_regime",
)
def _(t: Tables):
    feats = dc.dc_features(t.ticks, one(t), ONE, order="event_id", span=SPAN)
    return dc.regime_stats(feats, order="event_id", span=SPAN)


@query(
    "A10_feature_quality",
    f"""WITH RECURSIVE {FEATS_SQL},
a AS (SELECT symbol, count(*) AS num_ticks_input FROM ticks GROUP BY ALL),
b AS (SELECT symbol, count(*) AS num_dc_events_input, count(*) FILTER (event_type LIKE 'PDCC%') AS num_pdcc_anchors FROM dc GROUP BY ALL),
c AS (SELECT symbol, count(*) AS num_ticks_output, sum(regime_up)::BIGINT AS regime_up_ticks, sum(regime_down)::BIGINT AS regime_down_ticks,
  count(*) FILTER (regime = 'none') AS none_regime_count, 0::BIGINT AS "null_count_PDCC2_UP", 0::BIGINT AS "null_count_PDCC_Down",
  count(*) FILTER ("OSV_Up" IS NULL) AS "null_count_OSV_Up", count(*) FILTER ("OSV_Down" IS NULL) AS "null_count_OSV_Down",
  0::BIGINT AS "null_count_OSV_Up_clamped", 0::BIGINT AS "null_count_OSV_Down_clamped" FROM feats GROUP BY ALL)
SELECT *, (num_ticks_input = num_ticks_output)::INT AS tick_count_match FROM a JOIN b USING (symbol) JOIN c USING (symbol)""",
)
def _(t: Tables):
    events = one(t)
    feats = dc.dc_features(t.ticks, events, ONE, order="event_id", span=SPAN)
    return dc.feature_quality(t.ticks, events, feats)


@query(
    "A13_max_overshoot",
    f"""WITH RECURSIVE {dc_sql()}
SELECT symbol, threshold_down, threshold_up, coalesce(max(max_osv) FILTER (event_type = 'OSV_Down'), 0) AS max_osv_down,
  coalesce(max(max_osv) FILTER (event_type = 'OSV_Up'), 0) AS max_osv_up FROM dc GROUP BY ALL""",
    "threshold_down threshold_up max_osv_down max_osv_up",
)
def _(t: Tables):
    return dc.max_overshoot(events_of(t))


def _regime_cte(td: float, name: str) -> str:
    return f"""{name} AS (SELECT t.event_id, coalesce(p.event_type = 'PDCC2_UP', false)::INT AS up,
  CASE WHEN p.event_type = 'PDCC2_UP' THEN (t.price - p.end_price) / p.end_price * 100 ELSE 0 END AS osv
  FROM ticks t ASOF LEFT JOIN (SELECT * FROM dc WHERE event_type LIKE 'PDCC%' AND threshold_down = {td}) p
  ON t.symbol = p.symbol AND t.ts >= p.end_time)"""


@query(
    "D7_cross_threshold_features",
    f"""WITH RECURSIVE {dc_sql([(0.1, 0.1), (0.3, 0.3)])}, {_regime_cte(0.1, 'a')}, {_regime_cte(0.3, 'b')}
SELECT t.symbol, t.ts, t.event_id, t.price, a.up AS "t0p1_regime_up", a.osv AS "t0p1_OSV_Up", b.up AS "t0p3_regime_up",
  b.osv AS "t0p3_OSV_Up" FROM ticks t JOIN a USING (event_id) JOIN b USING (event_id)""",
    "price t0p1_OSV_Up t0p3_OSV_Up",
)
def _(t: Tables):
    events = cut_lineage(events_of(t, [0.1, 0.3]))
    parts = [
        dc.dc_features(t.ticks, events, x, order="event_id", span=SPAN).withColumn(
            "threshold", F.lit(n)
        )
        for x, n in ((0.1, "t0p1"), (0.3, "t0p3"))
    ]
    return dc.cross_threshold_features(
        union_all(*parts), ["price"], ["regime_up", "OSV_Up"], ["t0p1", "t0p3"], tie=["event_id"]
    )


def _latents(t: Tables, parts: int = 4) -> DataFrame:
    """Each vector cut into equal slices that play the thresholds of one window."""
    width = F.size("embedding") / parts
    piece = lambda i: F.slice("embedding", (width * i).cast("int") + 1, width.cast("int"))
    rows = t.embeddings.select(
        F.col("vec_id").alias("window_id"),
        F.array(F.col("label").cast("double")).alias("y"),
        F.explode(
            F.array(
                *[F.struct(F.lit(f"t{i}").alias("threshold"), piece(i).alias("z")) for i in range(parts)]
            )
        ).alias("p"),
    ).select("window_id", "y", "p.*")
    return rows.withColumn("z_mean", F.col("z")).withColumn(
        "z_log_var", F.transform("z", lambda x: -x)
    )


@query(
    "D7_dc_features_wide",
    f"""WITH RECURSIVE {dc_sql([(0.1, 0.1), (0.3, 0.3)])}, {_regime_cte(0.1, 'a')}, {_regime_cte(0.3, 'b')}
SELECT t.symbol, t.ts, t.event_id, t.price, a.up AS "t0p1_regime_up", a.osv AS "t0p1_OSV_Up", b.up AS "t0p3_regime_up",
  b.osv AS "t0p3_OSV_Up" FROM ticks t JOIN a USING (event_id) JOIN b USING (event_id)""",
    "price t0p1_OSV_Up t0p3_OSV_Up",
)
def _(t: Tables):
    events = cut_lineage(events_of(t, [0.1, 0.3]))
    names = {"t0p1": 0.1, "t0p3": 0.3}
    return dc.dc_features_wide(
        t.ticks, events, names, ["regime_up", "OSV_Up"], order="event_id", span=SPAN
    )


@query(
    "D8_latent_concat",
    """SELECT vec_id AS window_id, list_sum(embedding::DOUBLE[]) AS z_sum, embedding[1]::DOUBLE AS z_first,
  -(embedding[-1])::DOUBLE AS log_var_last, len(embedding)::INT AS z_len, label::DOUBLE AS y_first FROM embeddings""",
    "z_sum z_first log_var_last y_first",
    5,
)
def _(t: Tables):
    out = ml.latent_concat(_latents(t), expected=4)
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select(
        "window_id", total.alias("z_sum"), F.col("z")[0].cast("double").alias("z_first"),
        F.element_at("z_log_var", -1).cast("double").alias("log_var_last"),
        F.size("z").alias("z_len"), F.col("y")[0].alias("y_first"),
    )


@query(
    "D8_stacked_labels",
    """SELECT vec_id AS window_id, 4 AS labels, label::DOUBLE + 2 AS by_name, label::DOUBLE + 3 AS by_number, label::DOUBLE AS unknown FROM embeddings""",
    "by_name by_number unknown",
)
def _(t: Tables):
    """The labels of all thresholds, and one of them by name, by a number beyond the last and by a name that isn't there."""
    number = F.substring("threshold", 2, 1).cast("double")
    rows = _latents(t).withColumn("y", F.transform("y", lambda x: x + number))
    stacked = ml.latent_concat(rows, label="stack", expected=4).select("window_id", "y")
    names = [f"t{i}" for i in range(4)]
    picked = lambda want: ml.pick_label(stacked, names, want).select("window_id", F.col("y")[0].alias("v"))
    out = stacked.select("window_id", F.size("y").alias("labels"))
    for name, want in (("by_name", "t2"), ("by_number", 9), ("unknown", "t7")):
        out = out.join(picked(want).withColumnRenamed("v", name), "window_id")
    return out


@query(
    "J4_zip_thresholds",
    """SELECT vec_id AS window_id, (len(embedding) // 2)::INT AS rows, embedding[1]::DOUBLE AS a,
  embedding[1 + len(embedding) // 2]::DOUBLE AS b, label::DOUBLE AS y FROM embeddings""",
    "a b y",
)
def _(t: Tables):
    half = (F.size("embedding") / 2).cast("int")
    side = lambda first: t.embeddings.select(
        F.col("vec_id").alias("window_id"),
        F.transform(
            F.slice("embedding", first, half), lambda v: F.array(v.cast("double"))
        ).alias("x"),
        F.array(F.col("label").cast("double")).alias("y"),
    )
    out = zip_thresholds([side(F.lit(1)), side(half + 1)], "window_id")
    return out.select(
        "window_id", F.size("x").alias("rows"), F.col("x")[0][0].alias("a"),
        F.col("x")[0][1].alias("b"), F.col("y")[0].alias("y"),
    )


@query(
    "D10_long_predictions",
    """SELECT vec_id AS sample_index, (i - 1)::INT AS horizon, embedding[i]::DOUBLE AS y_true,
  embedding[i + 1]::DOUBLE AS y_pred FROM embeddings, range(1, 6) r(i)""",
    "y_true y_pred",
)
def _(t: Tables):
    wide = t.embeddings.select(
        F.col("vec_id").alias("sample_index"),
        F.slice("embedding", 1, 5).cast("array<double>").alias("y_true"),
        F.slice("embedding", 2, 5).cast("array<double>").alias("y_pred"),
    )
    return ml.long_predictions(wide)


@query(
    "W15_sample_index",
    f"WITH {TICKS} SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1 AS sample_index FROM ticks",
    "price",
)
def _(t: Tables):
    return row_index(t.ticks, Timeline.of("symbol", "ts", "event_id", SPAN), "sample_index")
