"""Sessions and topics: centroids, cohesion, medoids, windows, clustering and name maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.functions.vector import cosine, norm


def centroids(points: DataFrame, by: str, v: str = "v") -> DataFrame:
    """by, cv: the unit vector of each group's mean, from sums per dimension (pre-aggregated in each task)."""
    dims = points.select(by, F.posexplode(v).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("x"))
    whole = dims.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select(by, F.transform("s", lambda p: p["x"]).alias("m"))
    return whole.select(by, F.transform("m", lambda x: x / norm(F.col("m"))).alias("cv"))


def cohesion(points: DataFrame, cents: DataFrame, by: str) -> DataFrame:
    """by, cohesion: the least cosine of a member to its centroid; -1 for fewer than two members."""
    sims = points.join(cents, by).select(by, cosine(F.col("v"), F.col("cv")).alias("sim"))
    return sims.groupBy(by).agg(F.round(F.when(F.count(F.lit(1)) < 2, F.lit(-1.0)).otherwise(F.min("sim")), 6).alias("cohesion"), F.count(F.lit(1)).alias("members"))


def medoids(points: DataFrame, cents: DataFrame, by: str, item: str) -> DataFrame:
    """by, item: the member nearest to the centroid, the least item on a tie."""
    sims = points.join(cents, by).select(by, item, F.round(cosine(F.col("v"), F.col("cv")), 9).alias("sim"))
    return sims.groupBy(by).agg(F.max_by(item, F.struct("sim", -F.col(item))).alias(item))


def label_of(summary):
    """A topic's label from its medoid's summary: the first sentence, 80 characters at most."""
    return F.substring(F.split(summary, r"\. ")[0], 1, 80)


def nickname_map(names: DataFrame) -> DataFrame:
    """prefix, name: beginnings of three letters or more that only one name has; a full name always stands for itself."""
    names = names.distinct()
    parts = names.where(F.length("name") > 3).select("name", F.explode(F.transform(F.sequence(F.lit(3), F.length("name") - 1), lambda i: F.substring(F.col("name"), F.lit(1), i))).alias("prefix"))
    one = parts.groupBy("prefix").agg(F.min("name").alias("name"), F.countDistinct("name").alias("n")).where("n = 1").select("prefix", "name")
    full = names.select(F.col("name").alias("prefix"), "name")
    return one.join(full.select("prefix"), "prefix", "left_anti").unionByName(full)


def chunk_windows(sessions: DataFrame, size: int, scope: str = "conv", order: tuple[str, ...] = ("event_date", "session_id")) -> DataFrame:
    """Sessions in order, `size` to a window."""
    n = F.row_number().over(W.partitionBy(scope).orderBy(*order))
    return sessions.withColumn("window", F.floor((n - 1) / size).cast("long"))


def kmeans_topics(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """vec_id, topic by k-means over the `v` column (batch form)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.withColumn("features", array_to_vector("v"))
    return KMeans(k=k, seed=seed, maxIter=10).fit(rows).transform(rows).select("vec_id", F.col("prediction").alias("topic"))


#: Sessions a topic is meant to have, how many times that many make it too large, and drifts after which all is clustered anew.
TARGET, OVERSIZE, DRIFTS = 5, 2, 3


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x)
    return x / (n if n else 1.0)


#: Rows whose distances to all centres are held at a time.
BLOCK = 2048


def _nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its squared distance, block by block."""
    at, gap, own = np.zeros(len(x), int), np.zeros(len(x)), (centre**2).sum(1)
    for i in range(0, len(x), BLOCK):
        part = x[i : i + BLOCK]
        at[i : i + BLOCK] = best = (own - 2 * part @ centre.T).argmin(1)
        gap[i : i + BLOCK] = ((part - centre[best]) ** 2).sum(1)
    return at, gap


def far_apart(x: np.ndarray, k: int, rng: np.random.Generator, weight: np.ndarray | None = None) -> list[int]:
    """Places of k rows (fewer, if no more differ), each next one of a few drawn by weight and squared distance the one that leaves the least cost. A centre costs a few passes over the rows."""
    w = np.ones(len(x)) if weight is None else weight
    draw = lambda odds, n: np.minimum(np.searchsorted(np.cumsum(odds), rng.random(n) * odds.sum()), len(x) - 1)
    picked = [int(draw(w, 1)[0])]
    gap = ((x - x[picked[0]]) ** 2).sum(1)
    while len(picked) < k and (w * gap).sum() > 0:
        tried = draw(w * gap, 2 + int(np.log(k)))
        left = [np.minimum(gap, ((x - x[i]) ** 2).sum(1)) for i in tried]
        best = int(np.argmin([(w * g).sum() for g in left]))
        picked.append(int(tried[best]))
        gap = left[best]
    return picked


def seeded_kmeans(x: np.ndarray, k: int, starts: int = 10, rounds: int = 50) -> np.ndarray:
    """Labels of k-means, the best of `starts` runs by inertia, from seeded far-apart centres. Memory is the rows and a block of distances."""
    rng, best = np.random.default_rng(0), (np.inf, np.zeros(len(x), int))
    for _ in range(starts):
        centre = x[far_apart(x, k, rng)]
        for _ in range(rounds):
            at, _ = _nearest(x, centre)
            n = np.bincount(at, minlength=len(centre))
            new = np.zeros_like(centre)
            np.add.at(new, at, x)
            new = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], centre)
            if np.allclose(new, centre):
                break
            centre = new
        inertia = float(((x - centre[at]) ** 2).sum())
        if inertia < best[0] - 1e-12:
            best = (inertia, at)
    return best[1]


class TopicMaps:
    """What Topics knows, in memory: of each topic the sum of its vectors and its sessions; of each session its vector."""

    def __init__(self, state: dict | None = None):
        s = state or {"topics": {}, "vectors": [], "drifts": 0, "generation": 0}
        self.topics, self.vectors = {t: tuple(x) for t, x in s["topics"].items()}, {int(i): v for i, v in s["vectors"]}
        self.drifts, self.generation = s["drifts"], s["generation"]

    def names(self) -> list[str]:
        return list(self.topics)

    def topic(self, name: str) -> tuple[list[float], list[int]]:
        return self.topics[name]

    def put(self, name: str, total: list[float], members: list[int]) -> None:
        self.topics[name] = (total, members)

    def drop(self, name: str) -> None:
        del self.topics[name]

    def vector(self, session: int) -> list[float]:
        return self.vectors[session]

    def keep(self, session: int, v: list[float]) -> None:
        self.vectors[session] = v

    def sessions(self) -> list[int]:
        return sorted(self.vectors)

    def state(self) -> dict:
        return {"topics": self.topics, "vectors": list(self.vectors.items()), "drifts": self.drifts, "generation": self.generation}


class Topics:
    """A conversation's topics as its sessions arrive: each goes to the topic of the nearest centroid, whatever the distance.

    It has drifted if it fits that topic worse than every session that is in it (a topic of one session takes
    anything). After DRIFTS drifts since the last time, or when a topic holds more than OVERSIZE * TARGET sessions, all sessions are
    clustered anew, under a new generation of names. A centroid comes from the topic's running sum; an arrival reads the
    sums of all topics and the vectors of one. maps: TopicMaps, or the same over keyed state.
    """

    def __init__(self, maps: TopicMaps | None = None):
        self.maps = TopicMaps() if maps is None else maps
        self.drifts, self.generation = self.maps.drifts, self.maps.generation

    @property
    def members(self) -> dict[str, list[int]]:
        return {t: self.maps.topic(t)[1] for t in self.maps.names()}

    def state(self) -> dict:
        self.maps.drifts, self.maps.generation = self.drifts, self.generation
        return self.maps.state()

    def cohesion(self, topic: str) -> float:
        total, own = self.maps.topic(topic)
        centre = _unit(np.asarray(total))
        return min(float(np.asarray(self.maps.vector(i)) @ centre) for i in own) if len(own) > 1 else -1.0

    def assign(self, v: list[float], session: int | None = None) -> dict:
        """topic, generation, cosine (null for a first session), opened, drifted, reclustered."""
        x = _unit(np.asarray(v, float))
        i = len(self.maps.sessions()) if session is None else session
        self.maps.keep(i, x.tolist())
        names = self.maps.names()
        if not names:
            topic = f"{self.generation}_0"
            self.maps.put(topic, x.tolist(), [i])
            return {"topic": topic, "generation": self.generation, "cosine": None, "opened": True, "drifted": False, "reclustered": False}
        near = np.array([_unit(np.asarray(self.maps.topic(t)[0])) for t in names]) @ x
        topic, cosine_ = names[int(near.argmax())], float(near.max())
        drifted = cosine_ < self.cohesion(topic)
        total, own = self.maps.topic(topic)
        own = [*own, i]
        self.maps.put(topic, (np.asarray(total) + x).tolist(), own)
        self.drifts += drifted
        again = len(own) > OVERSIZE * TARGET or self.drifts >= DRIFTS
        if again:
            topic = self._recluster(names, i)
        return {"topic": topic, "generation": self.generation, "cosine": cosine_, "opened": False, "drifted": drifted, "reclustered": again}

    def _recluster(self, names: list[str], i: int) -> str:
        """All sessions clustered anew; the topic of session i."""
        sessions = self.maps.sessions()
        x = np.array([self.maps.vector(s) for s in sessions])
        labels = seeded_kmeans(x, max(1, min(len(x), round(len(x) / TARGET))))
        self.generation, self.drifts, mine = self.generation + 1, 0, ""
        for t in names:
            self.maps.drop(t)
        for j in sorted(set(labels.tolist())):
            own = [sessions[n] for n in np.flatnonzero(labels == j)]
            self.maps.put(f"{self.generation}_{j}", x[labels == j].sum(0).tolist(), own)
            mine = f"{self.generation}_{j}" if i in own else mine
        return mine


ASSIGNED = "topic string, generation int, cosine double, opened boolean, drifted boolean, reclustered boolean"


def assign_topics(arrivals: DataFrame, scope: str = "conv") -> DataFrame:
    """scope, seq, previous (seq of the session before, for the chain) and ASSIGNED, for sessions (scope, seq, v) in the order of seq.

    A conversation is a group of its own: its sessions, not its events, must fit one task.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        topics, names = Topics(), [c.split()[0] for c in ASSIGNED.split(", ")]
        out = pd.DataFrame([topics.assign(v) for v in pdf["v"]], columns=names)
        out.insert(0, "previous", pd.array([None, *pdf["seq"].tolist()[:-1]], dtype="Int64"))
        out.insert(0, "seq", pdf["seq"].to_numpy())
        out.insert(0, scope, pdf[scope].to_numpy())
        return out

    kinds = {f.name: f.dataType.simpleString() for f in arrivals.schema}
    return arrivals.groupBy(scope).applyInPandas(fold, f"{scope} {kinds[scope]}, seq {kinds['seq']}, previous {kinds['seq']}, {ASSIGNED}")


def topic_table(sessions: DataFrame, scope: str = "conv") -> DataFrame:
    """topics (scope, topic_id, session_ids, label): members in order, and the label of the session that is nearest to their centroid. sessions: scope, session_id, seq, topic, v, summary."""
    rows = sessions.withColumn("topic_id", F.concat_ws("_", F.lit("topic"), scope, "topic"))
    cents = centroids(rows, "topic_id")
    near = rows.join(cents, "topic_id").withColumn("sim", F.round(cosine(F.col("v"), F.col("cv")), 9))
    best = near.groupBy(scope, "topic_id").agg(F.min_by("summary", F.struct(-F.col("sim"), "seq")).alias("summary"), F.array_sort(F.collect_list(F.struct("seq", "session_id"))).alias("x"))
    return best.select(scope, "topic_id", F.transform("x", lambda x: x["session_id"]).alias("session_ids"), label_of(F.col("summary")).alias("label"))


def topic_of_session(topics: DataFrame, scope: str = "conv", order: str = "seq") -> DataFrame:
    """scope, session_id, topic_id: of several topics that list a session the last one (by order). topics: scope, topic_id, session_ids, order."""
    return topics.select(scope, "topic_id", order, F.explode("session_ids").alias("session_id")).groupBy(scope, "session_id").agg(F.max_by("topic_id", order).alias("topic_id"))


def event_session(events: DataFrame, stars: DataFrame, scope: str = "conv") -> DataFrame:
    """scope, node, session_id: the session that an event is linked to: of those that point to it the first, else of those that it points to (by adj_pos)."""
    into = stars.where("edge_type = 'contains'").select(scope, F.col("dst").alias("node"), F.col("src").alias("session_id"), F.lit(0).alias("side"), "adj_pos")
    out = stars.where("edge_type = 'belongs_to'").select(scope, F.col("src").alias("node"), F.col("dst").alias("session_id"), F.lit(1).alias("side"), "adj_pos")
    return events.select(scope, "node").join(into.unionByName(out), [scope, "node"]).groupBy(scope, "node").agg(F.min_by("session_id", F.struct("side", "adj_pos")).alias("session_id"))


def normalize_participants(events: DataFrame, names: DataFrame, scope: str = "conv") -> DataFrame:
    """events with participants replaced by the name that their beginning stands for (names: scope, prefix, name; in lower case), sorted, each once."""
    long = events.select(scope, "event_id", F.explode_outer("participants").alias("p")).withColumn("prefix", F.lower("p")).join(names, [scope, "prefix"], "left")
    new = long.groupBy(scope, "event_id").agg(F.array_sort(F.collect_set(F.coalesce("name", "p"))).alias("participants"))
    return events.drop("participants").join(new, [scope, "event_id"])


def encode_texts(df: DataFrame, text: str, dims: int = 64) -> DataFrame:
    """Adds `v`: signed feature hashing of a text's tokens, the encoder that needs no model. Batches of Arrow, a row each."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zlib

        for s in batches:
            out = []
            for t in s.fillna(""):
                v = np.zeros(dims)
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % dims] += 1 if h >> 31 else -1
                out.append(v.tolist())
            yield pd.Series(out)

    return df.withColumn("v", F.pandas_udf(run, "array<double>")(F.col(text)))
