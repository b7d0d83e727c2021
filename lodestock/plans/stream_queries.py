"""Keyed state of a stream whose files come out of order, and the rows that it rejects."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.store import shared_folder
from ..streaming.upsert import KeyedState, stream_into
from .registry import query, table

#: Quarters of the events in the order in which they come.
ARRIVAL = (0, 2, 1, 3)
JUDGED = """with q as (select *, cast(floor(event_id * 4.0 / ((select max(event_id) from events) + 1)) as integer) as quarter from events),
a as (select *, case quarter when 2 then 1 when 1 then 2 else quarter end as batch from q),
p as (select *, first_value(event_type) over (partition by user_id order by batch, event_id) as own from a),
j as (select *, case when event_type <> own then 'reparented' when batch = 2 and exists (select 1 from p l where l.user_id = p.user_id and l.batch = 1 and l.event_type = l.own) then 'late' end as reason from p)"""


def streamed(spark, sf_dir: str) -> KeyedState:
    """Events as rows of users (key), which keep their first event's type (parent); the third quarter comes before the second."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    root = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    top = e.agg(F.max("event_id")).first()[0]
    quarter = F.floor(F.col("event_id") * 4.0 / ((-1 if top is None else top) + 1))
    for q in ARRIVAL:  # one after another, so that their times tell their order
        e.where(quarter == q).coalesce(1).write.mode("append").parquet(f"{root}/files")
    return stream_into(spark, f"{root}/files/", KeyedState(spark, f"{root}/users", e.schema, key="user_id", order="event_id", parent="event_type"))


@query(JUDGED + " select user_id, event_type, max(event_id) as event_id, arg_max(value, event_id) as value from j where reason is null group by user_id, event_type")
def stream_keyed_state(spark, sf_dir):
    return streamed(spark, sf_dir).state()


@query(JUDGED + " select event_id, user_id, event_type, batch, reason from j where reason is not null")
def stream_rejected(spark, sf_dir):
    return streamed(spark, sf_dir).rejected().select("event_id", "user_id", "event_type", "batch", "reason")
