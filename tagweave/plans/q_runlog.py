"""Queries: run-log operators over ``events`` (run = user_id, metric value =
value, step = order of (ts, event_id) inside the run)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.operators import runlog as RL
from tagweave.plans.catalog import register
from tagweave.plans.fixtures import run_log

STEPS_SQL = """st as (select user_id as run_id, event_id, value,
       row_number() over (partition by user_id order by ts, event_id) as step from events)"""


def _steps(spark, sf_dir):
    return RL.with_steps(run_log(spark, sf_dir), "run_id", ("ts", "event_id"))


@register("best_checkpoint", f"""with {STEPS_SQL},
mx as (select run_id, max(value) as m from st group by run_id)
select st.run_id, min(st.step) as step, any_value(st.value) as value
from st join mx on mx.run_id = st.run_id and st.value = mx.m group by st.run_id
""")
def q_best_checkpoint(spark, sf_dir):
    r = RL.best_checkpoint(_steps(spark, sf_dir), "f1", "run_id", "step", "value", eps=1e-5)
    return r.select("run_id", F.col("step").cast("long").alias("step"), "value")


@register("windowed_mean_loss", f"""with {STEPS_SQL}
select run_id, ((step - 1) // 4)::BIGINT as window_id, round(avg(value / 4.0), 6) as mean_loss
from st group by 1, 2 having count(*) = 4
""")
def q_windowed_mean_loss(spark, sf_dir):
    r = RL.windowed_mean_loss(_steps(spark, sf_dir), 4)
    return r.select("run_id", F.col("window_id").cast("long").alias("window_id"),
                    F.round("mean_loss", 6).alias("mean_loss"))


@register("every_nth_step", f"""with {STEPS_SQL}
select run_id, step, event_id, value from st where step % 5 = 0
""")
def q_every_nth_step(spark, sf_dir):
    r = RL.every_nth_step(_steps(spark, sf_dir), 5)
    return r.select("run_id", F.col("step").cast("long").alias("step"), "event_id", "value")
