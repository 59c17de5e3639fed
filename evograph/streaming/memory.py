"""One ingest for an arriving session: topic, support, temporal edges, evolution and validity, on keyed state per conversation.

Nothing of a conversation is read or written whole. State is maps with small values, and a session touches the keys of its
own participants, candidates and topics alone:

* lists: for each subset of a participant set (up to SMALL members) and each size of a set that has it, the first DEPTH events, and how
  many are valid. As the sets of one size that share a subset are as similar to a probe as that makes them at least, the
  first few of each list hold every candidate, and the valid ones below any similarity are counted by inclusion and exclusion.
* sets, places: for larger sets, where each member's sets are (in pieces of PIECE), so that they are compared one by one.
* events: what a verdict needs of an event that may be a candidate; validity and causes: of events that have some.
* topics, vectors: running sums and members of a topic, a session's vector.

The state needs the RocksDB provider (spark.sql.streaming.stateStore.providerClass), which keeps maps by key. `replayed` gives the
same edges and validity over a table, by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from evograph.operators import overlap, validity
from evograph.operators.hierarchy import Topics
from evograph.shared import merge_join
from evograph.streaming.incremental import rule_verdict

#: Members of a set that is listed by its subsets; events of a list (no cap of a candidate list may be larger); sets of a piece.
SMALL, DEPTH, PIECE = overlap.SMALL, 20, 256
#: Least similarity and most candidates for support, temporal edges and evolution.
SUPPORT, TEMPORAL, EVOLUTION = (0.5, 5), (0.3, 20), (0.5, 10)
CAUSAL, BREAKING, PASSING = ("causes", "enables", "prevents"), ("causes", "prevents"), ("causes", "enables")

#: what: topic, edge, valid (an event's new validity), broken (an edge that is no longer valid), seen (an event's pool and screened ones), late.
OUT = "conv bigint, what string, src bigint, dst bigint, edge_type string, anchor date, update_val double, pool bigint, screened bigint, topic string"
#: Keyed state: name, key, value.
MAPS = {
    "lists": ("key string", "sizes array<int>, valid array<bigint>, first array<array<bigint>>"),
    "sets": ("key string", "valid bigint, first array<bigint>"),
    "places": ("key string", "sets array<string>"),
    "events": ("id bigint", "key string, session bigint, seq bigint, topic string, day date, kind string, value double"),
    "validity": ("id bigint", "anchor date, val double"),
    "causes": ("id bigint", "other array<bigint>, out array<boolean>, kind array<string>, broken array<boolean>"),
    "topics": ("topic string", "total array<double>, members array<bigint>"),
    "vectors": ("session bigint", "v array<double>"),
}


class Held:
    """A map of the state as a session sees it: each key is read once and written once."""

    def __init__(self, state):
        self.state, self.now, self.changed = state, {}, set()

    def get(self, key):
        if key not in self.now:
            self.now[key] = tuple(self.state.getValue((key,))) if self.state.containsKey((key,)) else None
        return self.now[key]

    def put(self, key, *value):
        self.now[key] = value
        self.changed.add(key)

    def drop(self, key):
        self.put(key, None)

    def keys(self):
        stored = {k[0] for k in self.state.keys()}  # noqa: SIM118
        return {k for k in stored | set(self.now) if self.get(k) is not None and self.get(k) != (None,)}

    def flush(self):
        for key in self.changed:
            if self.now[key] == (None,):
                if self.state.containsKey((key,)):
                    self.state.removeKey((key,))
            else:
                self.state.updateValue((key,), self.now[key])


class Conversation:
    """What one conversation knows, over maps of Held's kind; session() folds an arriving one."""

    def __init__(self, maps: dict, verdict: Callable, link: Callable):
        self.m, self.verdict, self.link = maps, verdict, link

    # Candidates

    @staticmethod
    def subsets(members: list[str]) -> list[str]:
        return ["\x1f".join(x) for n in range(1, len(members) + 1) for x in combinations(members, n)]

    def held(self, name: str, key, empty: tuple) -> tuple:
        value = self.m[name].get(key)
        return empty if value is None or value == (None,) else value

    def count(self, key: str, by: int) -> None:
        """`by` more valid events of this set, in every list that has it."""
        members = key.split("\x1f")
        for s in self.subsets(members) if len(members) <= SMALL else []:
            sizes, valid, first = (list(x) for x in self.held("lists", s, ([], [], [])))
            valid[sizes.index(len(members))] += by
            self.m["lists"].put(s, sizes, valid, first)
        valid, first = self.held("sets", key, (0, []))
        self.m["sets"].put(key, valid + by, first)

    def add(self, r) -> None:
        """An event becomes a candidate for later sessions."""
        members = sorted({p.lower() for p in r["participants"] or []})
        if not members:
            return
        key, size, kept = "\x1f".join(members), len(members), False
        for s in self.subsets(members) if size <= SMALL else []:
            sizes, valid, first = (list(x) for x in self.held("lists", s, ([], [], [])))
            if size not in sizes:
                sizes, valid, first = [*sizes, size], [*valid, 0], [*first, []]
            i = sizes.index(size)
            if len(first[i]) < DEPTH:
                first[i], kept = [*first[i], r["event_id"]], True
            self.m["lists"].put(s, sizes, valid, first)
        valid, first = self.held("sets", key, (0, None))
        if first is None:  # a new set: each of its members knows where it is
            first = []
            for m in members:
                for book in ("all", *(["large"] if size > SMALL else [])):
                    piece = 0
                    while len(self.held("places", f"{book}{piece}\x1f{m}", ([],))[0]) >= PIECE:
                        piece += 1
                    self.m["places"].put(f"{book}{piece}\x1f{m}", [*self.held("places", f"{book}{piece}\x1f{m}", ([],))[0], key])
        if len(first) < DEPTH:
            first, kept = [*first, r["event_id"]], True
        self.m["sets"].put(key, valid, first)
        if kept:
            self.m["events"].put(r["event_id"], key, r["session_num"], r["event_seq"], r["topic"], r["event_date"], r["kind"], r["value"])
        self.count(key, 1)

    def sets_of(self, members: list[str], book: str) -> set[str]:
        out: set[str] = set()
        for m in members:
            piece = 0
            while found := self.held("places", f"{book}{piece}\x1f{m}", ([],))[0]:
                out.update(found)
                piece += 1
        return out

    def near(self, members: list[str]) -> tuple[dict[int, float], Callable[[float], int]]:
        """Similarity by id of what may be among the DEPTH most similar events; and how many valid ones have at least some similarity."""
        best: dict[int, float] = {}
        counts: list[tuple[float, int]] = []
        n = len(members)
        small = n <= SMALL
        if small:
            valid: dict[tuple[str, int], int] = {}
            for s in reversed(self.subsets(members)):
                both = s.count("\x1f") + 1
                for size, count, first in zip(*self.held("lists", s, ([], [], [])), strict=True):
                    valid[s, size] = count
                    j = both / (n + size - both)
                    for e in first:
                        best[e] = max(best.get(e, 0.0), j)
            # Events whose set shares this subset with the probe and no more: those that share it, less those that share more.
            exact: dict[tuple[str, int], int] = {}
            for s, size in sorted(valid, key=lambda x: -x[0].count("\x1f")):
                inner = set(s.split("\x1f"))
                exact[s, size] = valid[s, size] - sum(c for (t, z), c in exact.items() if z == size and t != s and inner < set(t.split("\x1f")))
            counts = [((b := s.count("\x1f") + 1) / (n + size - b), c) for (s, size), c in exact.items()]
        own = set(members)
        for key in self.sets_of(members, "large" if small else "all"):
            other = set(key.split("\x1f"))
            j = len(own & other) / len(own | other)
            count, first = self.held("sets", key, (0, []))
            counts.append((j, count))
            for e in first:
                best[e] = max(best.get(e, 0.0), j)
        return best, lambda least: sum(c for j, c in counts if j >= least)

    def top(self, best: dict[int, float], bound: tuple[float, int]) -> list[tuple[int, tuple]]:
        """(id, event) of the candidates: most similar first, then in the order of arrival."""
        found = [(-j, self.held("events", e, ())[1:3], e) for e, j in best.items() if j >= bound[0]]
        return [(e, self.held("events", e, ())) for _, _, e in sorted(found)[: bound[1]]]

    # Edges and validity

    def edge(self, conv, src: int, dst: int, kind: str, **more) -> tuple:
        """Writes an edge over what stood between the two."""
        for a, b, out in ((src, dst, True), (dst, src, False)):
            old = self.held("causes", a, ([], [], [], []))
            kept = [x for x in zip(*old, strict=True) if (x[0], x[1]) != (b, out)]
            if kind in CAUSAL:
                kept.append((b, out, kind, False))
            if len(kept) != len(old[0]) or kind in CAUSAL:
                self.m["causes"].put(a, *(list(x) for x in zip(*kept, strict=True))) if kept else self.m["causes"].drop(a)
        return row(conv, "edge", src=src, dst=dst, edge_type=kind, **more)

    def supersede(self, conv, new, old: int) -> Iterator[tuple]:
        key = self.held("events", old, ())[0]
        self.count(key, -1)
        self.m["validity"].put(old, new["event_date"], 0.0)
        yield row(conv, "valid", src=old, anchor=new["event_date"], update_val=0.0)
        links = [list(x) for x in zip(*self.held("causes", old, ([], [], [], [])), strict=True)]
        for link in links:
            other, out, kind, broken = link
            if kind in BREAKING and not broken:
                link[3] = True
                theirs = [(o, w, k, True if (o, w) == (old, not out) else b) for o, w, k, b in zip(*self.held("causes", other, ([], [], [], [])), strict=True)]
                if theirs:
                    self.m["causes"].put(other, *(list(x) for x in zip(*theirs, strict=True)))
                yield row(conv, "broken", src=old if out else other, dst=other if out else old, edge_type=kind, anchor=new["event_date"])
            if out and kind in PASSING:
                anchor, val = self.held("validity", other, (None, 1.0))
                if val > 0.5:
                    self.m["validity"].put(other, anchor, 0.5)
                    yield row(conv, "valid", src=other, anchor=anchor, update_val=0.5)
        if links:
            self.m["causes"].put(old, *(list(x) for x in zip(*links, strict=True)))

    def session(self, conv, rows: list) -> Iterator[tuple]:
        """rows: the events of one session, in order, with their topic. Inserts, links, and then propagates, as one session after another does."""
        near = {}
        for r in rows:
            for c in r["causes"] or []:
                yield self.edge(conv, r["event_id"], c["dst"], c["edge_type"])
            members = sorted({p.lower() for p in r["participants"] or []})
            near[r["event_id"]] = self.near(members) if members else ({}, lambda _: 0)
        for r in rows:
            best = near[r["event_id"]][0]
            gate = lambda found: [(e, x) for e, x in found if r["topic"] is None or x[3] == r["topic"]]  # noqa: B023, E731
            for e, x in gate(self.top(best, TEMPORAL)):
                if r["event_date"] is not None and x[4] is not None and x[4] != r["event_date"]:
                    a, b = (e, r["event_id"]) if x[4] < r["event_date"] else (r["event_id"], e)
                    yield self.edge(conv, a, b, "temporal_before")
            for e, x in gate(self.top(best, SUPPORT)):
                if kind := self.link(r, x):
                    yield self.edge(conv, e, r["event_id"], kind)
        gone: dict[str, int] = {}  # how many of a set this session has superseded: pools were counted before it
        for r in rows:
            best, pool = near[r["event_id"]]
            screened = [(e, x) for e, x in self.top(best, EVOLUTION) if self.held("validity", e, (None, 1.0))[0] is None and self.held("validity", e, (None, 1.0))[1] > 0]
            own = {p.lower() for p in r["participants"] or []}
            less = sum(n for key, n in gone.items() if len(own & set(key.split("\x1f"))) >= EVOLUTION[0] * len(own | set(key.split("\x1f"))) and own)
            yield row(conv, "seen", src=r["event_id"], pool=pool(EVOLUTION[0]) - less, screened=len(screened))
            made = [(e, kind) for e, x in screened if (kind := self.verdict(r, x))]
            for e, kind in made:
                yield self.edge(conv, r["event_id"], e, kind)
            for e, kind in made:
                if kind == "updates":
                    key = self.held("events", e, ())[0]
                    gone[key] = gone.get(key, 0) + 1
                    yield from self.supersede(conv, r, e)
        for r in rows:
            self.add(r)


def row(conv, what: str, **more) -> tuple:
    names = [c.split()[0] for c in OUT.split(", ")]
    return tuple({"conv": conv, "what": what, **more}.get(n) for n in names)


def by_rule(new, old: tuple) -> str | None:
    """rule_verdict on an event (a row) and an earlier one (as it is kept)."""
    return rule_verdict(new["kind"], new["value"], old[5], old[6])


def supports(new, old: tuple) -> str | None:
    return "supports"


class Memory(StatefulProcessor):
    """Folds a conversation's sessions as they come. A session that comes after a later one is late: it is told, and changes nothing."""

    def __init__(self, verdict: Callable = by_rule, link: Callable = supports):
        self.verdict, self.link = verdict, link

    def init(self, handle) -> None:
        self.maps = {name: handle.getMapState(name, key, value) for name, (key, value) in MAPS.items()}
        self.last = handle.getValueState("last", "session bigint, drifts int, generation int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        names = [c.split()[0] for c in OUT.split(", ")]
        maps = {name: Held(m) for name, m in self.maps.items()}
        last, drifts, generation = tuple(self.last.get()) if self.last.exists() else (None, 0, 0)
        sessions: dict[int, list] = {}
        for r in rows:
            sessions.setdefault(r["session_num"], []).append(r.asDict(recursive=False))
        for num in sorted(sessions):
            own = sorted(sessions[num], key=lambda r: (r["event_seq"], r["event_id"]))
            if last is not None and num <= last:
                yield from (Row(*names)(*row(key[0], "late", src=r["event_id"])) for r in own)
                continue
            last = num
            if own[0]["v"] is not None:  # the session's summary decides its topic; else topics come with the events
                topics = Topics(TopicState(maps, drifts, generation))
                told = topics.assign(own[0]["v"], num)
                drifts, generation = topics.drifts, topics.generation
                own = [r | {"topic": told["topic"]} for r in own]
                yield Row(*names)(*row(key[0], "topic", src=num, topic=told["topic"]))
            for out in Conversation(maps, self.verdict, self.link).session(key[0], own):
                yield Row(*names)(*out)
        for m in maps.values():
            m.flush()
        self.last.update((last, drifts, generation))

    def close(self) -> None:
        pass


class TopicState:
    """Topics' state, topic by topic and session by session."""

    def __init__(self, maps: dict, drifts: int, generation: int):
        self.maps, self.drifts, self.generation = maps, drifts, generation

    def names(self) -> list[str]:
        return sorted(self.maps["topics"].keys(), key=lambda t: [int(x) for x in t.split("_")])

    def topic(self, name: str) -> tuple[list[float], list[int]]:
        return self.maps["topics"].get(name)

    def put(self, name: str, total: list[float], members: list[int]) -> None:
        self.maps["topics"].put(name, total, members)

    def drop(self, name: str) -> None:
        self.maps["topics"].drop(name)

    def vector(self, session: int) -> list[float]:
        return self.maps["vectors"].get(session)[0]

    def keep(self, session: int, v: list[float]) -> None:
        self.maps["vectors"].put(session, v)

    def sessions(self) -> list[int]:
        return sorted(self.maps["vectors"].keys())


def remember(events: DataFrame, verdict: Callable = by_rule, link: Callable = supports) -> DataFrame:
    """OUT rows for a stream of events (conv, session_num, event_id, event_seq, participants, topic, event_date, kind, value, causes (array of dst,
    edge_type; null: none), v (the session's summary, or null)). A session's events come in one batch."""
    return events.groupBy("conv").transformWithState(Memory(verdict, link), OUT, "Append", "None")


# The same over a table


def screened(events: DataFrame, bound: tuple[float, int], keep: tuple[str, ...] = ()) -> DataFrame:
    """conv, event_id, cand_id, jaccard, rank and `keep` of both: the candidates that were there when an event's session arrived."""
    return overlap.overlap_topk(events, *bound, group="session_num", keep=("session_num", "event_seq", *keep), past=True)


def replayed(events: DataFrame, verdict: Callable | None = None, recorded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges: conv, src, dst, edge_type; events' validity: conv, event_id, valid_until, update_val), without a fold.

    verdict: a column function of the candidate pairs' columns; or recorded: conv, src, dst, edge_type, of any origin.
    events: as for remember(), with a topic.
    """
    def verdicts(near: DataFrame) -> DataFrame:
        """The pairs that may evolve, with the verdicts that count. A lower bound's best pairs begin with a higher one's."""
        pairs = near.where((F.col("jaccard") >= EVOLUTION[0]) & (F.col("rank") <= EVOLUTION[1]))
        pairs = pairs.select("conv", F.col("event_id").alias("src"), F.col("cand_id").alias("dst"), F.struct("session_num", "event_seq").alias("at"), "kind", "value", "event_date", "cand_kind", "cand_value")
        if recorded is not None:
            pairs = merge_join(pairs, recorded.select("conv", "src", "dst", F.col("edge_type").alias("verdict")), ["conv", "src", "dst"], "left")
        else:
            pairs = pairs.withColumn("verdict", (verdict or rule)(pairs))
        return validity.settle(pairs).where("verdict IS NOT NULL")

    # All edges come from one search, by the widest bound; validity, which needs the evolving pairs alone, from a narrower one.
    widest = min(j for j, _ in (SUPPORT, TEMPORAL, EVOLUTION)), max(n for _, n in (SUPPORT, TEMPORAL, EVOLUTION))
    near = screened(events, widest, ("kind", "value", "event_date", "topic"))
    within = lambda bound: (F.col("jaccard") >= bound[0]) & (F.col("rank") <= bound[1])
    gate = overlap.gated(near, "topic")
    later, earlier = F.col("cand_event_date") > F.col("event_date"), F.col("cand_event_date") < F.col("event_date")
    edge = lambda when, src, dst, kind: F.when(when, F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("edge_type")))
    linked = F.array(
        edge(within(SUPPORT), "cand_id", "event_id", "supports"),
        edge(within(TEMPORAL) & earlier, "cand_id", "event_id", "temporal_before"),
        edge(within(TEMPORAL) & later, "event_id", "cand_id", "temporal_before"),
    )
    links = gate.select("conv", F.inline(F.filter(linked, lambda x: x.isNotNull())))
    given = events.select("conv", F.col("event_id").alias("src"), F.inline("causes"))
    edges = verdicts(near).select("conv", "src", "dst", F.col("verdict").alias("edge_type")).unionByName(links.unionByName(given.select("conv", "src", "dst", "edge_type")))
    updates = verdicts(screened(events, EVOLUTION, ("kind", "value", "event_date")))
    fresh = events.select("conv", "event_id", F.lit(None).cast("date").alias("valid_until"), F.lit(1.0).alias("update_val"))
    anchors = updates.where("verdict = 'updates'").select("conv", "src", "dst", F.col("event_date").alias("anchor"))
    return edges, validity.propagate_updates(fresh, given.withColumn("t_invalid_at", F.lit(None).cast("date")), anchors)[0]


def rule(pairs: DataFrame):
    """by_rule as a column of candidate pairs."""
    return F.when(F.col("kind") == F.col("cand_kind"), "updates").when(F.abs(F.col("value") - F.col("cand_value")) > 50, "contradicts")
