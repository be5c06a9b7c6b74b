"""The write path in order: each candidate meets what the candidates before it left.

What a write can change for a later one is little, and tells which rows must be taken in order:

- An accepted value changes the incumbents of its subject's key; so single-valued candidates are
  folded by subject.
- Accepted evidence changes what a correction of its object may retire; it joins that subject's fold.
- An accepted CONTRADICTS edge concerns every candidate at its ends, and a correction may retire it.
  Candidates that meet at such an end, directly or through one another, are folded together.
- An accepted PRECEDES edge concerns candidates of its weakly connected component, and only where
  a cycle is possible at all.

Everything else depends on entities and on the store alone: C4 and C8 too, since a write that
could mend them fails them itself. So these checks are joins, as in ``constraints``, and two folds
stream the rows that are left, with the store's edges as the state they begin with. A fold's task
holds the accepted state of one group at a time.

The store's edges are taken to obey the registry. Of a triple that the store holds twice the edge of
the smallest seq counts. Windows are closed; an open end is infinite. A null status of a task allows
no change. Rows of one seq are taken in any order; seq is meant to be unique.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ontology as o
from ..sources.scratch import settled
from . import constraints, graph
from .policies import ordered_fold
from .validate import blank, first_failure

FIRST = -(1 << 62)
OPEN = 1 << 61


class Held:
    """Active values of a key by object: dated ones in slots of their length's power of two, so that overlaps are found without a scan."""

    def __init__(self) -> None:
        self.entry: dict[str, tuple] = {}
        self.undated: dict[str, None] = {}
        self.slots: dict[int, dict[int, set[str]]] = {}

    def put(self, obj: str, entry: tuple) -> None:
        """``entry`` is (pct, from, to, is it dated, id)."""
        self.drop(obj)
        self.entry[obj] = entry
        _, lo, hi, dated, _ = entry
        if not dated:
            self.undated[obj] = None
            return
        level = (hi - lo).bit_length() if hi > lo else 0
        self.slots.setdefault(level, {}).setdefault(lo >> level, set()).add(obj)

    def drop(self, obj: str) -> None:
        if obj in self.entry:
            _, lo, hi, dated, _ = self.entry.pop(obj)
            if not dated:
                del self.undated[obj]
                return
            level = (hi - lo).bit_length() if hi > lo else 0
            table = self.slots[level]
            table[lo >> level].discard(obj)
            if not table[lo >> level]:
                del table[lo >> level]

    def others(self, obj: str, lo: int, hi: int, dated: bool) -> Iterator[str]:
        """Objects other than ``obj`` whose windows meet [lo, hi]; an undated side meets all."""
        if not dated:
            yield from (x for x in self.entry if x != obj)
            return
        yield from (x for x in self.undated if x != obj)
        for level, table in self.slots.items():
            a, b = (lo >> level) - 1, hi >> level
            near = range(a, b + 1) if b - a < len(table) else [s for s in table if a <= s <= b]
            for s in near:
                for x in table.get(s, ()):
                    if x != obj and self.entry[x][1] <= hi and lo <= self.entry[x][2]:
                        yield x


class Key:
    """The active values of one single-valued key, confident ones apart: only these can block."""

    def __init__(self, high: int) -> None:
        self.high, self.top, self.rest = high, Held(), Held()

    def put(self, obj: str, entry: tuple) -> None:
        self.top.drop(obj)
        self.rest.drop(obj)
        (self.top if entry[0] > self.high else self.rest).put(obj, entry)

    def has(self, obj: str) -> bool:
        return obj in self.top.entry or obj in self.rest.entry

    def meet(self, me: tuple, obj: str) -> tuple[int | None, bool]:
        """(the highest confidence met if it can block, else that of some value met; null if none is), are all of them dated."""
        _, lo, hi, dated, _ = me
        most = max((self.top.entry[x][0] for x in self.top.others(obj, lo, hi, dated)), default=None)
        if most is None:
            low = next(self.rest.others(obj, lo, hi, dated), None)
            most = None if low is None else self.rest.entry[low][0]
        loose = not dated or any(x != obj for h in (self.top, self.rest) for x in list(h.undated)[:2])
        return most, not loose

    def retire(self, me: tuple, obj: str) -> list[str]:
        """Drop all values met; their ids."""
        out = []
        for held in (self.top, self.rest):
            gone = list(held.others(obj, me[1], me[2], me[3]))
            out += [held.entry[x][4] for x in gone]
            for x in gone:
                held.drop(x)
        return out


class Group:
    """Accepted state of one group of subjects: values by key, CONTRADICTS edges by end, evidence by subject."""

    def __init__(self, high: int, enough: int) -> None:
        self.high, self.enough = high, enough
        self.keys: dict[tuple[str, str], Key] = {}
        self.contradicts: dict[str, dict[str, tuple]] = {}
        self.evidence: dict[str, int] = {}
        self.backed: dict[str, set[str]] = {}

    def key(self, r) -> Key:
        return self.keys.setdefault((r.subject_id, r.predicate), Key(self.high))

    def link(self, a: str, b: str, pct: int, name: str) -> None:
        for end in {a, b}:
            self.contradicts.setdefault(end, {})[name] = (pct, a, b)

    def links(self, r) -> dict[str, tuple]:
        return {**self.contradicts.get(r.subject_id, {}), **self.contradicts.get(r.object_id, {})}

    def back(self, r) -> None:
        """Count an accepted piece of evidence beside the store's, once a pair, as far as a correction could need it."""
        if self.evidence.get(r.object_id, 0) < self.enough and r.subject_id not in self.backed.setdefault(r.object_id, set()):
            self.backed[r.object_id].add(r.subject_id)
            self.evidence[r.object_id] = self.evidence.get(r.object_id, 0) + 1


def _judge(high: int, margin: int, enough: int, authoritative: bool):
    """Step of the fold: (state, row) to (state, rows of seq, verdict, kind, retired)."""

    def step(g: Group, r):
        me = (int(r.pct), int(r.lo), int(r.hi), bool(r.dated), r.name)
        if r.part == "value":
            g.key(r).put(r.object_id, me)
            return g, []
        if r.part == "contradicts":
            g.link(r.subject_id, r.object_id, me[0], r.name)
            return g, []
        single = r.predicate in o.SINGLE_VALUED
        met = {} if r.predicate == "CONTRADICTS" else g.links(r)
        if met:
            most, dated = max(x[0] for x in met.values()), False
        elif single:
            most, dated = g.key(r).meet(me, r.object_id)
        else:
            most, dated = None, False
        blocked = most is not None and me[0] > high and most > high
        kind = "none" if most is None else "temporal" if dated else "hard" if blocked else "soft"
        retired: list[str] = []
        if blocked:
            held = int(r.sourced) + int(r.n_support) + g.evidence.get(r.subject_id, 0)
            wins = r.write_intent == "correction" and me[0] - most > margin and held >= enough
            if not (wins or authoritative and r.write_intent == "update"):
                return g, [(r.at, "quarantine", kind, [])]
            if met:
                for name, (_, a, b) in met.items():
                    for end in {a, b}:
                        g.contradicts[end].pop(name, None)
                retired = sorted(met)
            else:
                retired = sorted(g.key(r).retire(me, r.object_id))
        elif r.fails_later:
            return g, [(r.at, "pass", kind, [])]
        if single:
            if blocked or not g.key(r).has(r.object_id):
                g.key(r).put(r.object_id, me)
        elif r.predicate == "CONTRADICTS":
            if not any((a, b) == (r.subject_id, r.object_id) for _, a, b in g.contradicts.get(r.subject_id, {}).values()):
                g.link(r.subject_id, r.object_id, me[0], r.name)
        elif r.predicate == "EVIDENCE_FOR" and r.backs and not r.known:
            g.back(r)
        return g, [(r.at, "supersede" if blocked else "pass", kind, retired)]

    return step


class Acyclic:
    """A topological order kept under insertion: only places between the two ends of an edge against the order are searched."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.after: dict[str, set[str]] = {}
        self.before: dict[str, set[str]] = {}
        self.ordered = True

    def _node(self, x: str) -> None:
        if x not in self.place:
            self.place[x] = len(self.place)
            self.after[x], self.before[x] = set(), set()

    def _reach(self, start: str, edges: dict[str, set[str]], inside) -> set[str]:
        seen, todo = {start}, [start]
        while todo:
            for y in edges[todo.pop()]:
                if y not in seen and inside(y):
                    seen.add(y)
                    todo.append(y)
        return seen

    def closes(self, u: str, v: str) -> bool:
        """Whether v already leads to u."""
        if u == v:
            return True
        self._node(u)
        self._node(v)
        if not self.ordered:
            return u in self._reach(v, self.after, lambda y: True)
        p = self.place
        return p[v] < p[u] and u in self._reach(v, self.after, lambda y: p[y] <= p[u])

    def insert(self, u: str, v: str) -> None:
        self._node(u)
        self._node(v)
        p = self.place
        if self.ordered and p[v] < p[u]:
            ahead = self._reach(v, self.after, lambda y: p[y] <= p[u])
            if u in ahead:
                # The store itself holds a cycle: from here on paths are searched in full.
                self.ordered = False
            else:
                back = self._reach(u, self.before, lambda y: p[y] >= p[v])
                moved = sorted(back, key=p.get) + sorted(ahead, key=p.get)
                for x, k in zip(moved, sorted(p[x] for x in moved)):
                    p[x] = k
        self.after[u].add(v)
        self.before[v].add(u)


def closing(edges: DataFrame, candidates: DataFrame, rounds: int = 3) -> DataFrame:
    """seq of candidates(seq, src, dst, enters) that close a cycle with the edges(src, dst) and the entering candidates before them.

    An edge can lie on a cycle only if something leads to its source and its target leads on;
    ``rounds`` rounds drop others. What is left is folded by weakly connected component.
    """
    loops = candidates.where("src = dst").select("seq")
    every = edges.select(F.lit(None).cast("long").alias("seq"), "src", "dst", F.lit(True).alias("enters")).distinct().unionByName(candidates.where("src <> dst").select("seq", "src", "dst", "enters"))
    for _ in range(rounds):
        every = every.join(every.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(every.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").checkpoint()
    comp = graph.components(every.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    rows = every.join(comp.select(F.col("node").alias("src"), "comp"), "src").withColumn("at", F.coalesce("seq", F.lit(FIRST)))

    def step(state, r):
        given = r.at == FIRST
        bad = not given and state.closes(r.src, r.dst)
        if r.enters and not bad:
            state.insert(r.src, r.dst)
        return state, [(r.at,)] if bad else []

    found = ordered_fold(rows.select("comp", "at", "src", "dst", "enters"), ["comp"], "at", "seq long", Acyclic, step)
    return loops.unionByName(found)


def _links(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """(a, b) of nodes whose rows must be folded together: a candidate's group node and its ends among the ends of CONTRADICTS edges."""
    at = lambda c: rows.join(ends.select(F.col("node").alias(c)), c, "left_semi")
    both = at("subject_id").join(ends.select(F.col("node").alias("object_id")), "object_id", "left_semi").select(F.col("subject_id").alias("a"), F.col("object_id").alias("b"))
    by_subject = at("subject_id").where("node is not null and node <> subject_id").select(F.col("node").alias("a"), F.col("subject_id").alias("b"))
    by_object = at("object_id").where("node is not null and node <> object_id").select(F.col("node").alias("a"), F.col("object_id").alias("b"))
    return both.unionByName(by_subject).unionByName(by_object)


def decide(candidates: DataFrame, entities: DataFrame, edges: DataFrame, margin_pct: int = 10, evidence_min: int = 1, high_pct: int = 80, authoritative: bool = False) -> DataFrame:
    """seq, failed_check, action, kind, retired of each candidate in the order of seq.

    ``kind`` is what the contradiction check met: none, soft, hard or temporal (all dated and
    overlapping). ``retired`` names what a supersession replaces: w and the seq of a candidate, or s and
    that of an edge of the store. ``authoritative``: an update replaces incumbents whatever its
    confidence and evidence.
    """
    x = constraints.examine_alone(candidates, entities, edges)
    check = dict(constraints.checks())
    first = lambda *names: first_failure([(n, check[n]) for n in names])
    when = lambda c, other: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(other))
    dated = F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull()
    window = [when("valid_from", -OPEN).alias("lo"), when("valid_to", OPEN).alias("hi"), dated.alias("dated")]
    triple = ["subject_id", "predicate", "object_id"]
    backs = F.coalesce(F.col("s_entity_type").isin("Document", "Event"), F.lit(False))
    # What the folds and the verdict need of a row, written once.
    x = settled(x.select(
        "seq", *triple, F.col("pct").cast("long").alias("pct"), *window, "write_intent", (~blank("source_ref")).alias("sourced"), F.col("s_n_support").alias("n_support"), backs.alias("backs"),
        first("C1", "C2").alias("early"), first("C4", "C5", "C6").alias("mid"), first("C8", "C9", "C10").alias("late"),
    ))

    precedes = x.where("predicate = 'PRECEDES' and early is null")
    entering = precedes.select("seq", F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), F.coalesce(F.col("mid"), F.col("late")).isNull().alias("enters"))
    closes = closing(graph.predicate_subgraph(edges, "PRECEDES"), entering).withColumn("closes", F.lit(True))

    live = x.where("early is null and mid is null and predicate <> 'PRECEDES'")
    single = F.col("predicate").isin(*o.SINGLE_VALUED)
    live = live.withColumn("node", F.when(single, F.col("subject_id")).when(F.col("predicate") == "EVIDENCE_FOR", F.col("object_id")))
    contra = edges.where("predicate = 'CONTRADICTS'").select("subject_id", "object_id").unionByName(live.where("predicate = 'CONTRADICTS' and late is null").select("subject_id", "object_id"))
    ends = contra.select(F.explode(F.array("subject_id", "object_id")).alias("node")).distinct().checkpoint()
    links = contra.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b")).unionByName(_links(live, ends))
    comp = graph.components(links)
    # A status or slot value is no end of a contradiction: its component would be a hub.
    label = ends.join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), F.lit(True).alias("is_end"))
    label = label.unionByName(comp.join(ends, "node", "left_anti").select("node", "comp", F.lit(False).alias("is_end"))).checkpoint()

    grouped = live
    for c in ("subject_id", "object_id"):
        grouped = grouped.join(label.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"), F.col("is_end").alias(f"{c}_end")), c, "left")
    own = F.when(single, F.col("subject_id_comp")).when(F.col("predicate") == "EVIDENCE_FOR", F.col("object_id_comp"))
    grp = F.coalesce(own, "subject_id_comp", F.when(F.col("object_id_end"), F.col("object_id_comp")), F.col("node"))
    # Evidence that the store holds is counted there; no other row asks what the store holds.
    held = edges.where("predicate = 'EVIDENCE_FOR'").select(*triple).distinct().withColumn("known", F.lit(True))
    cols = ["grp", "at", "part", *triple, "pct", "lo", "hi", "dated", "write_intent", "sourced", "n_support", "fails_later", "known", "backs", "name"]
    folded = grouped.withColumn("grp", grp).where("grp is not null").withColumns({"at": F.col("seq"), "part": F.lit("write"), "fails_later": F.col("late").isNotNull(), "name": F.concat(F.lit("w"), "seq")})
    backing = folded.where("predicate = 'EVIDENCE_FOR'").join(held, triple, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    folded = settled(folded.where("predicate <> 'EVIDENCE_FOR'").withColumn("known", F.lit(False)).select(cols).unionByName(backing.select(cols)))

    def seed(df, part, *window):
        at = df.join(label.select(F.col("node").alias("subject_id"), "comp"), "subject_id", "left").withColumn("grp", F.coalesce("comp", "subject_id"))
        no = F.lit(False)
        return at.join(folded.select("grp").distinct(), "grp", "left_semi").select(
            "grp", F.lit(FIRST).alias("at"), F.lit(part).alias("part"), *triple, F.col("pct").cast("long").alias("pct"), *window, F.lit("").alias("write_intent"), no.alias("sourced"),
            F.lit(0).cast("long").alias("n_support"), no.alias("fails_later"), no.alias("known"), no.alias("backs"), F.concat(F.lit("s"), "seq").alias("name"),
        )

    lone = edges.groupBy(*triple).agg(F.min_by(F.struct("seq", "pct", "valid_from", "valid_to"), "seq").alias("e")).select(*triple, "e.*")
    none = [F.lit(-OPEN).alias("lo"), F.lit(OPEN).alias("hi"), F.lit(False).alias("dated")]
    rows = folded.unionByName(seed(lone.where(F.col("predicate").isin(*o.SINGLE_VALUED)), "value", *window)).unionByName(seed(lone.where("predicate = 'CONTRADICTS'"), "contradicts", *none))
    step = _judge(high_pct, margin_pct, evidence_min, authoritative)
    verdict = ordered_fold(rows, ["grp"], "at", "seq long, verdict string, kind string, retired array<string>", lambda: Group(high_pct, evidence_min), step)

    # An order of events is in no other fold, so a row has one of the two results at most.
    out = x.select("seq", "early", "mid", "late").join(verdict.unionByName(closes, allowMissingColumns=True), "seq", "left")
    failed = F.coalesce("early", F.when(F.col("closes"), "C3"), "mid", F.when(F.col("verdict") != "pass", "C7"), "late")
    out = out.withColumn("failed_check", failed)
    f = F.col("failed_check")
    action = F.when(f.isNull(), "accept").when(f.isin(*constraints.REJECTS), "reject").when((f == "C7") & (F.col("verdict") == "supersede"), "supersede").otherwise("quarantine")
    return out.select("seq", "failed_check", action.alias("action"), F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("retired", F.array().cast("array<string>")).alias("retired"))


def state_after(decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """name, status, superseded_by of every candidate (w and seq) and every edge of the store (s and seq) after the batch."""
    decisions = settled(decisions.select("seq", "action", "retired"))  # both readers below would fold again
    gone = decisions.select(F.explode("retired").alias("name"), F.concat(F.lit("w"), "seq").alias("superseded_by"), "seq").groupBy("name").agg(F.max_by("superseded_by", "seq").alias("superseded_by"))
    status = F.when(F.col("action").isin("accept", "supersede"), "accepted").when(F.col("action") == "reject", "rejected").otherwise("quarantined")
    rows = decisions.select(F.concat(F.lit("w"), "seq").alias("name"), status.alias("status"))
    held = edges.select(F.concat(F.lit("s"), "seq").alias("name"), F.lit("accepted").alias("status"))
    j = rows.unionByName(held).join(gone, "name", "left")
    return j.withColumn("status", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("status")))


