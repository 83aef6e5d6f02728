"""Registered queries: a pipeline with declared parameters, sources and result, dispatched by id; unknown ids are refused."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quernix.errors import FunctionError, TypeMismatch, UnboundParam, UnresolvedSource
from quernix.functions import expr as E
from quernix.functions.compile import Field
from quernix.plans import codec
from quernix.plans import steps as S
from quernix.plans.engine import run, schema_walk

_SAMPLE = {"int": 1, "bigint": 2**40, "float": 1.5, "bool": True, "string": "a"}


@dataclass(frozen=True)
class PipelineQuery:
    id: str
    source: str
    steps: tuple
    params: Mapping[str, str] = field(default_factory=dict)  # name: type, or list of it as "[int]"
    sources: Mapping[str, Mapping[str, Field]] = field(default_factory=dict)
    result: tuple[tuple[str, Field], ...] = ()


def _sample(t: str):
    import datetime as dt
    from decimal import Decimal

    if t.startswith("["):
        return (_sample(t[1:-1]),)
    return {"date": dt.date(2000, 1, 1), "timestamp": dt.datetime(2000, 1, 1)}.get(t, Decimal("1.0") if t.startswith("decimal") else _SAMPLE.get(t))


def check(spark: SparkSession, pq: PipelineQuery) -> None:
    """Parameters, sources and the result schema agree with the steps, both ways."""
    used = S.params_of(pq.steps)
    if used != set(pq.params):
        raise UnboundParam(f"declared {sorted(pq.params)}, used {sorted(used)}")
    wanted = S.sources_of(pq.steps) | {pq.source}
    if missing := wanted - set(pq.sources):
        raise UnresolvedSource(f"not declared: {', '.join(sorted(missing))}")
    if spare := set(pq.sources) - wanted:
        raise UnresolvedSource(f"declared but not read: {', '.join(sorted(spare))}")
    import datetime as dt

    env = {n: _sample(t) for n, t in pq.params.items()}
    clock = {"date": dt.date(2000, 1, 1), "timestamp": dt.datetime(2000, 1, 1)}
    schema, closed = schema_walk(spark, pq.steps, dict(pq.sources[pq.source]), tables={n: dict(s) for n, s in pq.sources.items()}, env=env, clock=clock)
    if not closed:
        raise TypeMismatch("the result schema depends on the data")
    if tuple(schema.items()) != tuple(pq.result):
        raise TypeMismatch(f"the result is {[(n, f.type, f.unit) for n, f in schema.items()]}")


class Registry:
    def __init__(self, spark: SparkSession, queries: Mapping[str, PipelineQuery] | None = None):
        self.spark, self._queries = spark, dict(queries or {})

    def register(self, pq: PipelineQuery) -> None:
        if pq.id in self._queries:
            raise FunctionError(f"{pq.id} is registered already")
        check(self.spark, pq)
        self._queries[pq.id] = pq

    def replace(self, pq: PipelineQuery) -> None:
        self.find(pq.id)
        check(self.spark, pq)
        self._queries[pq.id] = pq

    def unregister(self, id: str) -> None:
        self.find(id)
        del self._queries[id]

    def find(self, id: str) -> PipelineQuery:
        if id not in self._queries:
            raise FunctionError(f"no query {id}")
        return self._queries[id]

    def restrict(self, ids) -> Registry:
        return Registry(self.spark, {i: self.find(i) for i in ids})

    def union(self, other: Registry) -> Registry:
        if both := set(self._queries) & set(other._queries):
            raise FunctionError(f"registered twice: {', '.join(sorted(both))}")
        return Registry(self.spark, self._queries | other._queries)

    def enumerate(self) -> list[str]:
        return sorted(self._queries)

    def declarations(self) -> list[dict]:
        return [{"id": q.id, "params": dict(q.params), "sources": sorted(q.sources), "result": [(n, f.type, f.unit) for n, f in q.result]} for _, q in sorted(self._queries.items())]

    def dispatch(self, id: str, args: Mapping, resolve: Callable[[str], DataFrame], clock: dict | None = None) -> DataFrame:
        """Binds the arguments and compiles; nothing is resolved for an unknown id or a wrong argument."""
        pq = self.find(id)
        if set(args) != set(pq.params):
            raise UnboundParam(f"{id} takes {sorted(pq.params)}, not {sorted(args)}")
        for n, t in pq.params.items():
            vs = args[n] if t.startswith("[") else (args[n],)
            for v in vs:
                kind = E.wrap(v).kind
                want = t.strip("[]")
                if kind not in (want, "null") and not (kind == "int" and want in ("bigint", "float")) and not want.startswith(kind):
                    raise TypeMismatch(f"{n} is {kind}, not {t}")
        tables = {n: resolve(n) for n in pq.sources}
        return run(self.spark, pq.steps, tables[pq.source], tables=tables, env=dict(args), clock=clock)


def encode(pq: PipelineQuery) -> str:
    f = lambda s: [{"name": n, "type": x.type} | ({"unit": x.unit} if x.unit else {}) for n, x in (s.items() if isinstance(s, Mapping) else s)]
    return codec.dumps({"$type": "pipelineQuery", "id": pq.id, "source": pq.source, "params": dict(pq.params), "sources": {n: f(s) for n, s in pq.sources.items()}, "result": f(pq.result), "steps": [codec.encode_step(s) for s in pq.steps]})


def decode(text: str) -> PipelineQuery:
    d = codec.loads(text)
    f = lambda rows: {r["name"]: Field(r["type"], r.get("unit")) for r in rows}
    return PipelineQuery(d["id"], d["source"], tuple(map(codec.decode_step, d["steps"])), d["params"], {n: f(s) for n, s in d["sources"].items()}, tuple(f(d["result"]).items()))
