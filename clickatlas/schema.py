"""Schemas of the stored graphs, ledgers, runs and goals."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

S, I, L, B = StringType(), IntegerType(), LongType(), BooleanType()


def struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


ITEM = struct(t=S, cells=ArrayType(S), level=I)
COLLECTION = struct(kind=S, count=I, items=ArrayType(ITEM))
CONTROL = struct(selector=S, text=S, tag=S, role=S, href=S, nav=B, bulk=B)
FIELD = struct(
    label=S, type=S, required=B, options=ArrayType(S), value=S, accept=S, selector=S, placeholder=S
)
FORM = struct(
    title=S, isDialog=B, fields=ArrayType(FIELD), submitButtons=ArrayType(S), submitSelector=S, fieldCount=I
)
STEP = struct(label=S, selector=S, href=S)

# --- documents as they lie on disk ------------------------------------------------
RAW_STATE = struct(id=S, url=S, label=S, depth=I, controls=ArrayType(CONTROL), collections=ArrayType(COLLECTION))
RAW_EDGE = StructType(
    [StructField("from", S), StructField("to", S), StructField("label", S), StructField("selector", S), StructField("kind", S)]
)
RAW_TRIGGER = struct(
    label=S, state=S, path=ArrayType(STEP), form=FORM, opensAt=S, kind=S, selector=S, href=S, accept=S,
    cachedAt=S, cacheSource=S, staleWarning=B,
)
RAW_META = struct(
    start=S, host=S, pages=I, states=I, edges=I, triggers=I, max_depth=I, tool=S, complete=B, stopped=S,
    lastLiveUpdate=S, liveHits=I,
)
RAW_NODE = struct(
    id=S, url=S, title=S, type=S, reason=S, accept=S, dlHref=S, dlKind=S, selector=S, error=S
)
RAW_LINK_EDGE = struct(source=S, target=S, label=S, kind=S, skipped=B)
INTERACTION_DOC = struct(
    meta=RAW_META, states=ArrayType(RAW_STATE), state_index=MapType(S, S), edges=ArrayType(RAW_EDGE),
    triggers=ArrayType(RAW_TRIGGER), nodes=ArrayType(RAW_NODE), _corrupt_record=S,
)
LINK_DOC = struct(
    meta=RAW_META, nodes=ArrayType(RAW_NODE), edges=ArrayType(RAW_LINK_EDGE), _corrupt_record=S
)

# --- tables -----------------------------------------------------------------------
STATES = struct(
    host=S, state_seq=L, id=S, url=S, label=S, depth=I, controls=ArrayType(CONTROL),
    collections=ArrayType(COLLECTION),
)
EDGES = struct(host=S, edge_seq=L, src=S, dst=S, label=S, selector=S, kind=S)
TRIGGERS = struct(
    host=S, trig_seq=L, label=S, state_id=S, path=ArrayType(STEP), form=FORM, opens_at=S, kind=S, selector=S,
    href=S, accept=S, cached_at=TimestampType(), cache_source=S, stale=B,
)
META = struct(
    host=S, graph_kind=S, start=S, pages=I, complete=B, stopped=S, last_live_update=TimestampType(), live_hits=I
)
NODES = struct(
    host=S, node_seq=L, id=S, url=S, title=S, type=S, reason=S, accept=S, dl_href=S, dl_kind=S, selector=S, error=S
)
LINK_EDGES = struct(host=S, edge_seq=L, src=S, dst=S, label=S, kind=S, skipped=B)

LEDGER = struct(sha256=S, name=S, path=S, size=L, source=S, seen_at=S, _corrupt_record=S)
RUN = struct(
    id=S, flow_id=S, host=S, status=S, dry_run=B, cancelled=B, capabilities=MapType(S, B),
    inputs=MapType(S, S), started_at=S, finished_at=S, duration_s=S, detail=S, aborted=S,
    stats=MapType(S, L), steps=ArrayType(struct(op=S, status=S)),
    artifacts=ArrayType(struct(name=S, status=S, sha256=S)), collected=MapType(S, S), _corrupt_record=S,
)
EXPECT = struct(status=S, url_contains=S, min_fields=I, phase=I)
GOALS_DOC = struct(
    sites=ArrayType(
        struct(
            name=S, start_url=S, host=S, max_states=I, max_depth=I,
            goals=ArrayType(struct(goal=S, start=S, expect=EXPECT)),
        )
    )
)
LIVE_RECORD = struct(
    host=S, rec_seq=L, start=S, trigger=S, steps=ArrayType(STEP), trigger_page=S, form=FORM, opens_at=S,
    kind=S, selector=S, href=S, accept=S,
)
