"""A pipeline as an editable tree: nodes with stable ids, checked edits, and addresses by content."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from quernix.errors import EditRejected
from quernix.functions.compile import Field
from quernix.plans import codec
from quernix.plans import steps as S


@dataclass(frozen=True)
class Node:
    id: str
    step: S.Step


@dataclass(frozen=True)
class Tree:
    nodes: tuple[Node, ...] = ()


def _id(at: int, s: S.Step) -> str:
    return hashlib.sha256(f"{at}:{codec.dumps(codec.encode_step(s))}".encode()).hexdigest()[:16]


def lift(steps) -> Tree:
    return Tree(tuple(Node(_id(i, s), s) for i, s in enumerate(steps)))


def lower(t: Tree) -> tuple[S.Step, ...]:
    return tuple(n.step for n in t.nodes)


def _at(t: Tree, id: str) -> int:
    for i, n in enumerate(t.nodes):
        if n.id == id:
            return i
    raise EditRejected(f"no node {id}")


def insert_after(t: Tree, id: str | None, s: S.Step) -> Tree:
    at = 0 if id is None else _at(t, id) + 1
    new = Node(_id(len(t.nodes), s), s)
    if any(n.id == new.id for n in t.nodes):
        new = replace(new, id=_id(len(t.nodes) + at + 1, s))
    return Tree((*t.nodes[:at], new, *t.nodes[at:]))


def remove(t: Tree, id: str) -> Tree:
    at = _at(t, id)
    return Tree((*t.nodes[:at], *t.nodes[at + 1 :]))


def update(t: Tree, id: str, s: S.Step) -> Tree:
    at = _at(t, id)
    return Tree((*t.nodes[:at], Node(id, s), *t.nodes[at + 1 :]))


def move(t: Tree, id: str, after: str | None) -> Tree:
    n = t.nodes[_at(t, id)]
    rest = remove(t, id)
    at = 0 if after is None else _at(rest, after) + 1
    return Tree((*rest.nodes[:at], n, *rest.nodes[at:]))


EDITS = {"insertAfter": insert_after, "remove": remove, "update": update, "move": move}


def apply(t: Tree, edit: tuple, spark: SparkSession | None = None, schema: dict[str, Field] | None = None, **kw) -> Tree:
    """One edit (name, *arguments); with a schema, an edit after which a step reads an unknown column is refused."""
    if edit[0] not in EDITS:
        raise EditRejected(f"no edit {edit[0]}; there are {', '.join(EDITS)}")
    out = EDITS[edit[0]](t, *edit[1:])
    if schema is not None:
        from quernix.errors import Refusal
        from quernix.plans.engine import schema_walk

        try:
            schema_walk(spark, lower(out), schema, **kw)
        except Refusal as e:
            raise EditRejected(f"{type(e).__name__}: {e}") from None
    return out


def apply_script(t: Tree, edits, **kw) -> Tree:
    for e in edits:
        t = apply(t, e, **kw)
    return t


def footprint(t: Tree) -> set[str]:
    """Columns the pipeline reads."""
    from quernix.streaming.delta import reads

    return reads(lower(t))


def pipeline_hash(t: Tree) -> str:
    return codec.pipeline_hash(lower(t))


def content_address(t: Tree, id: str) -> str:
    """An address of everything up to a node."""
    return codec.pipeline_hash(lower(t)[: _at(t, id) + 1])


def derive(before: Tree, after: Tree) -> list[tuple]:
    """Edits that turn one tree into the other: nodes are matched by id; unrelated trees are removed and inserted whole.

    After the edits the steps are those of ``after``; nodes that both have keep their ids.
    """
    edits: list[tuple] = []
    known, now = {n.id: n for n in after.nodes}, before

    def do(*edit) -> None:
        nonlocal now
        edits.append(edit)
        now = apply(now, edit)

    for n in before.nodes:
        if n.id not in known:
            do("remove", n.id)
    last = None
    for i, n in enumerate(after.nodes):
        have = next((m for m in now.nodes if m.id == n.id), None)
        if have is None:
            do("insertAfter", last, n.step)
        else:
            if now.nodes[i].id != n.id:
                do("move", n.id, last)
            if have.step != n.step:
                do("update", n.id, n.step)
        last = now.nodes[i].id
    return edits


def encode_edit(edit: tuple) -> str:
    """Canonical text of an edit."""
    return codec.dumps([codec.encode_step(x) if isinstance(x, S.Step) else x for x in edit])


def decode_edit(text: str) -> tuple:
    e = codec.loads(text)
    if not isinstance(e, list) or not e or e[0] not in EDITS:
        raise EditRejected(f"no edit; there are {', '.join(EDITS)}")
    return tuple(codec.decode_step(x) if isinstance(x, dict) else x for x in e)


@dataclass(frozen=True)
class Stream:
    """How a log of edits is applied, written and read."""

    spark: SparkSession | None = None
    schema: dict[str, Field] | None = None

    def apply(self, t: Tree, edit: tuple) -> Tree:
        return apply(t, edit, self.spark, self.schema)

    encode = staticmethod(encode_edit)
    decode = staticmethod(decode_edit)

    def replay(self, t: Tree, log: list[str]) -> Tree:
        for text in log:
            t = self.apply(t, decode_edit(text))
        return t
