"""Many path expressions in one pass over each document: a narrow plan, without a shuffle or a join.

The expressions become one trie of steps, in which equal beginnings are one node. The tags of a document, as the lexer
has them in an array, are folded from first to last with a stack of open elements. An element on the stack knows,
for every node of the trie, the activations that end at it (``own``) and those that end at it or at an element above
(``follow``); so a child step looks at ``own`` of the parent, a descendant step at ``follow``, and each element costs
one small expression a node. What a path's end selects is given out as the fold passes it.

Results are a bag: an activation is the list of places of the elements and attributes that led to it, and each one
gives its own row. An index or range counts the rows of one activation.

Texts of the quick lane are folded by :func:`walk` in Python workers, all others by the expression of :class:`Fold`;
both do the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from tagloom.operators.ahead import Chunk, Lane, ahead
from tagloom.operators.lexer import chunks_of
from tagloom.plans.pathexpr import Path, Step, parse

ACT = "struct<ord:int,ids:array<int>>"
OUT = "struct<path:int,seq:int,type:string,value:string,act:array<int>>"
BLOCK = 256


@dataclass
class Node:
    """A step of one or more expressions. ``ends``: the numbers of the expressions that end here."""

    step: Step | None
    parent: int
    number: int
    ends: list[int] = field(default_factory=list)


def trie(paths: list[Path]) -> list[Node]:
    """The nodes, parents first; node 0 is the root."""
    nodes, known = [Node(None, -1, 0)], {}
    for k, path in enumerate(paths):
        at = 0
        for step in path.steps:
            if (at, step) not in known:
                known[at, step] = len(nodes)
                nodes.append(Node(step, at, len(nodes)))
            at = known[at, step]
        nodes[at].ends.append(k)
    return nodes


def show(paths: list[Path]) -> str:
    """The trie as text, a line for each node: its steps, and the expressions that end there."""
    nodes, out = trie(paths), []
    for n in nodes:
        depth, at = 0, n
        while at.parent >= 0:
            depth, at = depth + 1, nodes[at.parent]
        out.append("  " * depth + (str(Path((n.step,))) if n.step else "root") + (f" -> {n.ends}" if n.ends else ""))
    return "\n".join(out)


def waiting(paths: list[Path], kind: str) -> list[int]:
    """The trie's nodes that a token of ``kind`` can lead to."""
    kinds = {"tag": ("OpenTag", "HeaderStart"), "has": ("TagAttribValue", "HeaderAttribValue"), "attr": ("TagAttribValue", "HeaderAttribValue"), "content": ("Content",),
             "close": ("CloseTag", "CloseTagIm", "HeaderEnd")}
    return [n.number for n in trie(paths) if n.step and kind in kinds[n.step.kind]]


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _named(names: tuple[str, ...] | None, column: Column) -> Column:
    return F.lit(True) if names is None else column.isin(*names)


def _fits(step: Step, attr: Column) -> Column:
    return _named(step.names, attr["name"]) & (F.lit(True) if step.value is None else attr["value"] == F.lit(step.value))


_acts = lambda: F.array().cast(f"array<{ACT}>")
_outs = lambda: F.array().cast(f"array<{OUT}>")


def _emit(k: int, seq: Column, kind: Column, value: Column, act: Column) -> Column:
    return F.struct(F.lit(k).alias("path"), seq.cast("int").alias("seq"), kind.alias("type"), value.alias("value"), act.alias("act")).cast(OUT)


def _join(parts: list[Column]) -> Column:
    return _outs() if not parts else parts[0] if len(parts) == 1 else F.concat(*parts)


class Fold:
    """The expression that gives all matches of a document's chunks."""

    def __init__(self, paths: list[Path]) -> None:
        self.nodes = trie(paths)
        # nodes that others go on from, or that end an expression with an event, are kept for each element; 0 is the root
        self.kept = [n.number for n in self.nodes if n.step is None or n.step.kind in ("tag", "has")]
        self.slot = {k: i for i, k in enumerate(self.kept)}
        self.state = f"struct<own:array<array<{ACT}>>,follow:array<array<{ACT}>>>"

    def root(self) -> Column:
        first = [F.array(F.struct(F.lit(-1).alias("ord"), F.array().cast("array<int>").alias("ids")).cast(ACT)) if k == 0 else _acts() for k in self.kept]
        return F.struct(F.array(*first).alias("own"), F.array(*first).alias("follow")).cast(self.state)

    def _of(self, lists: Column, number: int) -> Column:
        return F.get(lists, F.lit(self.slot[number]))

    def element(self, above: Column, name: Column, seq: Column, attrs: Column) -> Column:
        """The state of an element below ``above``. Its nodes are built one after the other, as conditions look at their parents."""
        def node(n: Node, own: Column) -> Column:
            if n.step is None:
                return _acts()
            if n.step.kind == "tag":
                acts = self._of(above["follow"] if n.step.deep else above["own"], n.parent)
                grown = F.transform(acts, lambda a: F.struct(F.lit(-1).alias("ord"), F.array_append(a["ids"], seq).alias("ids")))
                return F.when(_named(n.step.names, name), grown).otherwise(_acts())
            if n.parent == 0 and not n.step.deep:
                return _acts()
            # the parent's activations at this element have been found before
            acts = self._of(own, n.parent)
            acts = F.concat(self._of(above["follow"], n.parent), acts) if n.step.deep else acts
            fit = F.filter(attrs, lambda t: _fits(n.step, t))
            found = F.flatten(F.transform(acts, lambda a: F.transform(
                fit if n.step.deep else F.filter(fit, lambda t: t["ord"] > a["ord"]),
                lambda t: F.struct(t["ord"].alias("ord"), F.array_append(a["ids"], seq + 2 * t["ord"] + 2).alias("ids")))))
            return F.when(F.size(attrs) > 0, found).otherwise(_acts())

        tags = [n for n in self.nodes if n.number in self.slot]
        # runs of nodes that need no other of this element are one array
        stages: list[list[Node]] = []
        for n in tags:
            needs = n.step is not None and n.step.kind == "has"
            if not stages or needs and any(m.number == n.parent for m in stages[-1]):
                stages.append([])
            stages[-1].append(n)

        def build(i: int, own: Column | None) -> Column:
            if i == len(stages):
                follow = F.zip_with(above["follow"], own, lambda f, o: F.when(F.size(o) > 0, F.concat(f, o)).otherwise(f))
                return F.struct(own.alias("own"), follow.alias("follow"))  # no casts from here on: they would copy what a document has open, tag by tag
            more = F.array(*[node(n, own) for n in stages[i]])
            return _let(more if own is None else F.concat(own, more), lambda o: build(i + 1, o))

        return build(0, None)

    def at_open(self, e: Column, seq: Column, kind: Column, name: Column, attrs: Column) -> Column:
        def events(n: Node, k: int) -> Column:
            return F.transform(self._of(e["own"], n.number), lambda a: _emit(k, seq, kind, name, a["ids"]))

        def conditions(n: Node, k: int) -> Column:
            def one(a: Column) -> Column:
                value = F.element_at(F.filter(attrs, lambda t: t["ord"] == a["ord"]), 1)
                return _let(value, lambda t: _emit(k, F.element_at(a["ids"], -1), t["type"], t["value"], a["ids"]))

            return F.transform(self._of(e["own"], n.number), one)

        def values(n: Node, k: int) -> Column:
            def one(a: Column) -> Column:
                fit = F.filter(attrs, lambda t: _fits(n.step, t) & (F.lit(True) if n.step.deep else t["ord"] > a["ord"]))
                return F.transform(fit, lambda t: _emit(k, seq + 2 * t["ord"] + 2, t["type"], t["value"], a["ids"]))

            acts = self._of(e["follow"] if n.step.deep else e["own"], n.parent)
            return F.when(F.size(attrs) > 0, F.flatten(F.transform(acts, one))).otherwise(_outs())

        make = {"tag": events, "has": conditions, "attr": values}
        return _join([make[n.step.kind](n, k) for n in self.nodes if n.step is not None and n.step.kind in make and (n.step.kind != "attr" or n.step.deep or n.parent) for k in n.ends])

    def _at(self, kind: str, e: Column, emit) -> Column:
        def of(n: Node, k: int) -> Column:
            return F.transform(self._of(e["follow"] if n.step.deep and kind == "content" else e["own"], n.parent), lambda a: emit(k, a["ids"]))

        return _join([of(n, k) for n in self.nodes if n.step is not None and n.step.kind == kind and (kind == "content" or n.parent) for k in n.ends])

    def at_content(self, e: Column, seq: Column, value: Column) -> Column:
        return self._at("content", e, lambda k, act: _emit(k, seq, F.lit("Content"), value, act))

    def at_close(self, e: Column, seq: Column, kind: Column, value: Column) -> Column:
        return self._at("close", e, lambda k, act: _emit(k, seq, kind, value, act))

    def matches(self, chunks: Column) -> Column:
        """All matches of a document, in order of its chunks. What is given out is gathered in blocks, else long documents would copy it again and again."""
        stack, work = f"array<{self.state}>", "struct<seq:int,stack:{0},out:array<{1}>>"
        inner_type, outer_type = work.format(stack, OUT), work.format(stack, f"array<{OUT}>")
        empties = [(k, n) for n in self.nodes if n.step is None for k in n.ends]

        def step(st: Column, c: Column) -> Column:
            def on(head: Column) -> Column:
                seq, kind, value, size = st["seq"], head["type"], head["value"], F.size(st["stack"])
                top = F.element_at(st["stack"], -1)
                attrs = lambda: F.filter(c, lambda t: t["type"].isin("TagAttribValue", "HeaderAttribValue"))

                def done(stack: Column, out: Column) -> Column:
                    return F.struct((seq + F.size(c)).alias("seq"), stack.alias("stack"), F.concat(st["out"], out).alias("out"))

                def opened(a: Column) -> Column:
                    def with_element(e: Column) -> Column:
                        last = F.element_at(c, -1)
                        shut = last["type"].isin("CloseTagIm", "HeaderEnd")
                        out = self.at_open(e, seq, kind, value, a)
                        closed = F.when(shut, self.at_close(e, seq + F.size(c) - 1, last["type"], last["value"])).otherwise(_outs())
                        return done(F.when(shut | (kind == "HeaderStart"), st["stack"]).otherwise(F.array_append(st["stack"], e)), F.concat(out, closed))

                    return _let(self.element(top, value, seq, a), with_element)

                return (F.when(kind.isin("OpenTag", "HeaderStart"), _let(attrs(), opened))
                        .when(kind == "Content", done(st["stack"], self.at_content(top, seq, value)))
                        .when((kind == "CloseTag") & (size > 1), done(F.slice(st["stack"], 1, size - 1), self.at_close(top, seq, kind, value)))
                        .otherwise(done(st["stack"], _outs())))

            return _let(F.element_at(c, 1), on)

        def block(st: Column, b: Column) -> Column:
            begin = F.struct(st["seq"].alias("seq"), st["stack"].alias("stack"), _outs().alias("out"))
            return _let(F.aggregate(F.slice(chunks, b * BLOCK + 1, F.lit(BLOCK)), begin, step),
                        lambda got: F.struct(got["seq"].alias("seq"), got["stack"].alias("stack"), F.array_append(st["out"], got["out"]).alias("out")))

        start = F.struct(F.lit(0).alias("seq"), F.array(self.root()).alias("stack"), F.array().cast(f"array<array<{OUT}>>").alias("out")).cast(outer_type)
        found = F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(chunks) - 1) / BLOCK).cast("int")), start, block)["out"])
        first = F.get(F.get(chunks, F.lit(0)), F.lit(0))
        events = [F.array(_emit(k, F.lit(0), first["type"], first["value"], F.array().cast("array<int>"))) for k, _ in empties]
        return F.when(F.size(chunks) > 0, F.concat(*events, found) if events else found).otherwise(_outs())


def walk(paths: list[Path], acts: bool):
    """What :class:`Fold` gives, in Python: for :func:`tagloom.operators.ahead.ahead`. ``acts``: whether activations are wanted."""
    nodes = trie(paths)
    kept = [n for n in nodes if n.step is None or n.step.kind in ("tag", "has")]
    slot = {n.number: i for i, n in enumerate(kept)}
    names = {n.number: frozenset(n.step.names) if n.step and n.step.names is not None else None for n in nodes}
    grow = [(slot[n.number], n.step.kind == "tag", n.step.deep, slot[n.parent], names[n.number], n.step.value) for n in kept if n.step is not None and (n.step.kind == "tag" or n.step.deep or n.parent)]
    events = [(n.step.kind, n.step.deep, slot[n.number if n.number in slot else n.parent], names[n.number], n.step.value, n.ends)
              for n in nodes if n.step is not None and n.ends and n.step.kind in ("tag", "has", "attr") and (n.step.kind != "attr" or n.step.deep or n.parent)]
    contents = [(n.step.deep, slot[n.parent], n.ends) for n in nodes if n.step is not None and n.ends and n.step.kind == "content"]
    closes = [(slot[n.parent], n.ends) for n in nodes if n.step is not None and n.ends and n.step.kind == "close" and n.parent]
    empties = [k for n in nodes if n.step is None for k in n.ends]
    root = ([((-1, ()),) if n.step is None else () for n in kept],) * 2

    def fit(attrs: list, only: frozenset | None, value: str | None, after: int) -> list[int]:
        return [i for i, (name, v) in enumerate(attrs) if i > after and (only is None or name in only) and (value is None or v == value)]

    def element(above: tuple, name: str, seq: int, attrs: list) -> tuple:
        own, any_ = [()] * len(kept), False
        for at, tag, deep, parent, only, value in grow:
            if tag:
                found = above[deep][parent]
                if found and (only is None or name in only):
                    own[at], any_ = [(-1, (*ids, seq)) for _, ids in found], True
            elif attrs:
                found = [*above[1][parent], *own[parent]] if deep else own[parent]
                own[at] = [(i, (*ids, seq + 2 * i + 2)) for ord_, ids in found for i in fit(attrs, only, value, -1 if deep else ord_)]
                any_ = any_ or bool(own[at])
        return own, [[*f, *o] if o else f for f, o in zip(above[1], own, strict=True)] if any_ else above[1]

    def gather():
        out = path, place, kind, value, act = [], [], [], [], []

        def emit(ends: list[int], *row) -> None:
            for k in ends:
                for column, x in zip(out, (k, *row), strict=True):
                    column.append(x)

        def take(chunks: list[Chunk]) -> int:
            begin, seq, stack = len(path), 0, [root]
            if empties:
                emit(empties, 0, chunks[0][0], chunks[0][1], ())
            for head, name, family, attrs, last, n, _ in chunks:
                if head == "Content":
                    top = stack[-1]
                    for deep, parent, ends in contents:
                        for _, ids in top[deep][parent]:
                            emit(ends, seq, head, name, ids)
                elif head == "CloseTag":
                    if len(stack) > 1:
                        top = stack.pop()
                        for parent, ends in closes:
                            for _, ids in top[0][parent]:
                                emit(ends, seq, head, name, ids)
                elif head in ("OpenTag", "HeaderStart"):
                    e = element(stack[-1], name, seq, attrs)
                    for sort, deep, at, only, wanted, ends in events:
                        if sort == "tag":
                            for _, ids in e[0][at]:
                                emit(ends, seq, head, name, ids)
                        elif sort == "has":
                            for i, ids in e[0][at]:
                                emit(ends, ids[-1], family + "Value", attrs[i][1], ids)
                        elif attrs:
                            for ord_, ids in e[deep][at]:
                                for i in fit(attrs, only, wanted, -1 if deep else ord_):
                                    emit(ends, seq + 2 * i + 2, family + "Value", attrs[i][1], ids)
                    if last:
                        for parent, ends in closes:
                            for _, ids in e[0][parent]:
                                emit(ends, seq + n - 1, last, "", ids)
                    elif head == "OpenTag":
                        stack.append(e)
                seq += n
            return len(path) - begin

        def items() -> pa.Array:
            ids = pa.array(act, pa.list_(pa.int32())) if acts else pa.nulls(len(path), pa.list_(pa.int32()))
            return pa.StructArray.from_arrays([pa.array(path, pa.int32()), pa.array(place, pa.int32()), pa.array(kind, pa.string()), pa.array(value, pa.string()), ids],
                                              names=["path", "seq", "type", "value", "act"])

        return take, items

    return gather


def select_paths(df: DataFrame, id_col: str, text_col: str, expressions: dict[int, str | Path], **options) -> DataFrame:
    """``doc_id, seq, type_id, token_type, value``: what all ``expressions`` select of the texts, which are read and lexed once.

    Each row of ``df`` is a document of its own, whatever its id; null texts select nothing. ``options`` are those of
    the lexer. Without an index or range in an expression nothing is shuffled.
    """
    if not expressions:
        raise ValueError("no expression")
    types, paths = list(expressions), [parse(e) if isinstance(e, str) else e for e in expressions.values()]
    bare = [Path(p.steps) for p in paths]
    ranged = [k for k, p in enumerate(paths) if (p.low or p.high is not None) and p.steps and p.steps[-1].kind in ("content", "attr")]
    fold = lambda column: _let(chunks_of(column, options), Fold(bare).matches)
    # with ranges, a number for the row, given before its matches become rows
    row = [F.monotonically_increasing_id().alias("_row")] if ranged else []
    if options.get("html"):  # such texts have no quick lane
        rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row)
        matches = fold("text")
    else:
        rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *row)
        lane = Lane(**{k: v for k, v in options.items() if k != "html"})
        rows = ahead(rows, "text", _parse_datatype_string(f"array<{OUT}>"), lane, walk(bare, bool(ranged))).withColumn("text", F.col("text").cast("string"))
        matches = F.when(F.col("text").isNull(), F.col("found")).otherwise(fold("text"))
    found = rows.select("doc_id", *(["_row"] if ranged else []), F.explode_outer(matches).alias("m")).where("m is not null")
    if ranged:
        inside = F.lit(False)
        for k in ranged:
            low, high = paths[k].low, paths[k].high
            inside = inside | (F.col("m.path") == k) & (F.col("_n") >= low) & (F.lit(True) if high is None else F.col("_n") <= high)
        place = F.row_number().over(Window.partitionBy("_row", "m.path", "m.act").orderBy("m.seq")) - 1
        found = found.withColumn("_n", place).where(~F.col("m.path").isin(ranged) | inside).drop("_n")
    type_id = F.element_at(F.array(*[F.lit(t) for t in types]), F.col("m.path") + 1)
    return found.select("doc_id", "m.seq", type_id.alias("type_id"), F.col("m.type").alias("token_type"), "m.value")
