"""Embedding near-duplicates with product quantisation.

Vectors are normalised and dealt to coarse inverted lists, whose number grows with the square root of the counted vectors;
the residual to the list's centre is coded by a sub-codebook per subspace. A query probes its own list and every list
whose plane, between its own centre and the list's, it lies near enough to. A linked vector lies across the plane by the
part of the link's difference that points from centre to centre. How large that part is, is taken from the sample for each
two lists: the share of the spread around their centres, and around all centres, that lies in this direction, an even
share at least. `deviations` of its root are allowed, at most the whole link distance, from which on no link can be lost
(whenever a direction holds a twelfth of the spread or more, at the default). In a probed list, distances
come from a table per query and code (asymmetric); a vector is left out only if this distance less the vector's own
quantisation error exceeds the link distance. Those left are compared by exact cosine in double precision. Equally near
centres: the first one is the home. Recall is measured in the tests on vectors of even and uneven spread.

Vectors are compared only if their labels (not null) and dimensions are equal. Vectors that are null, empty, zero or hold
null or non-finite components, and those without an id, link with nothing and are kept. Equal vectors of a label form a
class, searched once. Rows: one output row per input row; repeated rows count each other as links. Empty tables give
empty results. Input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, sized
from .components import connected_components


#: Tables of lists of at most so many rows, as counted, are broadcast.
FEW = 500_000


@dataclass(frozen=True)
class Settings:
    """cosine: least one of a link; least_lists, and at least `per_list` vectors of the sample to a list: bounds of the number of lists; deviations: see above; sample: vectors, chosen by hash, that the codebooks are fitted on; block, queries: rows of a list, and of its queries, that one group holds."""

    cosine: float = 0.98
    least_lists: int = 32
    per_list: int = 16
    deviations: float = 3.5
    subspaces: int = 8
    codes: int = 256
    sample: int = 16_384
    block: int = 4096
    queries: int = 16_384

    def lists(self, n: int) -> int:
        """Lists of n vectors."""
        return max(self.least_lists, min(int(np.sqrt(n)), self.sample // self.per_list))

    @property
    def reach(self) -> float:
        """Distance of unit vectors at the least cosine, and a margin for rounding."""
        return float(np.sqrt(2 - 2 * self.cosine)) + 1e-6


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fitted(x: np.ndarray, width: int) -> np.ndarray:
    """The first width components, zeros where there are fewer: never farther apart than whole vectors of one dimension."""
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T, 0)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    k = min(k, len(x))
    centres = x[np.random.default_rng(7).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = squares(x, centres).argmin(1)
        n = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, column, k) for column in x.T], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class Quantiser:
    width: int
    coarse: np.ndarray
    books: list[np.ndarray]
    #: By home list and list: how far beyond their plane linked vectors are sought.
    across: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, n: int, s: Settings) -> Quantiser:
        """x: the sample of n vectors."""
        coarse = k_means(x, s.lists(n))
        home = squares(x, coarse).argmin(1)
        rest = x - coarse[home]
        books = [k_means(part, s.codes) for part in np.array_split(rest, min(s.subspaces, x.shape[1]), 1)]
        share = cls.shares(coarse, home, rest)
        return cls(x.shape[1], coarse, books, s.reach * np.minimum(1.0, s.deviations * np.sqrt(share)))

    @staticmethod
    def shares(coarse: np.ndarray, home: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """By home list and list: the largest share of spread in the direction between their centres, of all vectors' residuals, of either list's, and of an even spread."""
        k, width = coarse.shape
        out = np.full((k, k), 1 / width)
        whole = rest.T @ rest / max((rest * rest).sum(), 1e-300)
        for h in range(k):
            toward = coarse - coarse[h]
            length = np.sqrt((toward * toward).sum(1))
            toward = toward / np.where(length > 0, length, 1)[:, None]
            own = rest[home == h]
            spread = ((toward @ whole) * toward).sum(1)
            local = ((own @ toward.T) ** 2).sum(0) / max((own * own).sum(), 1e-300) if len(own) > 1 else np.ones(k)
            out[h] = np.maximum(out[h], np.maximum(spread, local))
        return np.maximum(out, out.T)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), 1)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of each row: its list, codes, quantisation error, and the lists it must probe."""
        d = squares(x, self.coarse)
        home = d.argmin(1)
        rest = x - self.coarse[home]
        codes = np.stack([squares(p, b).argmin(1) for p, b in zip(self.parts(rest), self.books)], 1).astype(np.uint8)
        back = np.concatenate([b[c] for b, c in zip(self.books, codes.T)], 1)
        error = np.sqrt(((rest - back) ** 2).sum(1))
        between = np.sqrt(squares(self.coarse, self.coarse))[home]
        beyond = (d - d[np.arange(len(x)), home][:, None]) <= 2 * self.across[home] * between + 1e-9
        return home, codes, error, [np.flatnonzero(row) for row in beyond]

    def tables(self, x: np.ndarray, at: int) -> np.ndarray:
        """Squared distances of the residuals of queries to list `at` from each code: (queries, subspaces, codes)."""
        out = [squares(p, b) for p, b in zip(self.parts(x - self.coarse[at]), self.books)]
        most = max(t.shape[1] for t in out)
        return np.stack([np.pad(t, ((0, 0), (0, most - t.shape[1]))) for t in out], 1)


def usable(vector: Column) -> Column:
    """Whether a vector can have links."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def train(classes: DataFrame, s: Settings) -> Quantiser | None:
    """Codebooks from at most s.sample classes chosen by hash; the dimension most of them have."""
    rows = classes.select("node", "vector").orderBy(F.xxhash64("node", "vector"), "node").limit(s.sample).toPandas()["vector"]
    if not len(rows):
        return None
    sizes = rows.map(len)
    width = int(sizes.mode().iloc[0])
    return Quantiser.fit(units(np.stack(rows[sizes == width].to_numpy()).astype(float)), classes.count(), s)


def dealt(classes: DataFrame, model: Quantiser, s: Settings) -> DataFrame:
    """A row for each class in its own list (query false), and one for each list that it probes."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, g in batch.groupby(batch["vector"].map(len)):
                x = fitted(units(np.stack(g["vector"].to_numpy()).astype(float)), model.width)
                home, codes, error, probes = model.assign(x)
                own = g.assign(at=home, query=False, codes=[c.tobytes() for c in codes], error=error)
                yield own
                n = [len(p) for p in probes]
                asks = g.loc[g.index.repeat(n)].assign(at=np.concatenate(probes), query=True, codes=None, error=None)
                for k in range(0, len(asks), 10_000):
                    yield asks.iloc[k : k + 10_000]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    rows = classes.mapInPandas(scan, f"{kinds}, at int, query boolean, codes binary, error double")
    return rows.withColumn("size", F.size("vector"))


def searched(rows: DataFrame, model: Quantiser, s: Settings) -> DataFrame:
    """(node, n, other): for each query and group the number of vectors that it links with (other null), and links enough to connect what the group's links connect (n null)."""
    names = ["label", "size", "at"]
    counts = checkpointed(rows.groupBy(*names).agg(F.sum((~F.col("query")).cast("long")).alias("n_own"), F.sum(F.col("query").cast("long")).alias("n_asked")).where("n_own > 0"))
    # One narrow row per list, so that the vectors are shuffled once only, to their groups.
    cut = rows.join(sized(counts, FEW).select(*names, F.ceil(F.col("n_own") / s.block).cast("int").alias("blocks"), F.ceil(F.col("n_asked") / s.queries).cast("int").alias("slices")), names)
    own, asked = F.pmod(F.xxhash64("node", "vector"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("vector", "node"), F.col("slices")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    groups = F.when(F.col("query"), F.transform(every("blocks"), lambda b: F.struct(b.alias("block"), asked.alias("slice")))).otherwise(F.transform(every("slices"), lambda q: F.struct(own.alias("block"), q.alias("slice"))))
    keys = [*names, "block", "slice"]
    spread = cut.withColumn("_g", F.explode(groups)).select(*names, "_g.block", "_g.slice", "query", "node", "copies", "vector", "codes", "error")

    def answers(at: int, g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        base, asks = g[~g["query"]], g[g["query"]]
        if not len(base) or not len(asks):
            return
        node, copies, error = base["node"].to_numpy(), base["copies"].to_numpy(), base["error"].to_numpy()
        exact = units(np.stack(base["vector"].to_numpy()).astype(float))
        codes = np.frombuffer(b"".join(base["codes"]), np.uint8).reshape(len(base), -1)
        order = {x: i for i, x in enumerate(dict.fromkeys([*node.tolist(), *asks["node"].tolist()]))}
        root = list(range(len(order)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for k in range(0, len(asks), 512):
            part = asks.iloc[k : k + 512]
            whole = units(np.stack(part["vector"].to_numpy()).astype(float))
            tables = model.tables(fitted(whole, model.width), at)
            far = np.zeros((len(part), len(base)))
            for sub in range(codes.shape[1]):
                far += tables[:, sub][:, codes[:, sub]]
            i, j = np.nonzero(np.sqrt(far) - error <= s.reach + 1e-6)
            asker = part["node"].to_numpy()
            good = np.zeros(len(i), bool)
            for c in range(0, len(i), 65_536):
                good[c : c + 65_536] = (whole[i[c : c + 65_536]] * exact[j[c : c + 65_536]]).sum(1) >= s.cosine
            good &= asker[i] != node[j]
            i, j = i[good], j[good]
            if not len(i):
                continue
            n = np.bincount(i, copies[j], len(part)).astype(np.int64)
            seen = np.flatnonzero(n)
            yield pd.DataFrame({"node": asker[seen], "n": pd.array(n[seen], "Int64"), "other": pd.array([None] * len(seen), "Int64")})
            tree = []
            for a, b in zip(asker[i].tolist(), node[j].tolist()):
                x, y = find(order[a]), find(order[b])
                if x != y:
                    root[x] = y
                    tree.append((a, b))
            if tree:
                yield pd.DataFrame({"node": [a for a, _ in tree], "n": pd.array([None] * len(tree), "Int64"), "other": pd.array([b for _, b in tree], "Int64")})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            ids = batch[keys].to_numpy()
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts[:-1]], cuts):
                yield from answers(int(ids[a, 2]), batch.iloc[a:b])
            rest = batch.iloc[cuts[-1] if len(cuts) else 0 :]
        if rest is not None:
            yield from answers(int(rest["at"].iloc[0]), rest)

    return spread.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(scan, "node long, n long, other long")


def near_duplicates(vectors: DataFrame, s: Settings = Settings(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vectors with n_links, component_id and kept."""
    outputs = ("n_links", "component_id", "kept")
    rows = vectors.drop(*[c for c in vectors.columns if c.lower() in outputs])
    able = usable(F.col(vector)) & F.col(label).isNotNull() & F.col(vec_id).isNotNull()
    # An id may stand for several vectors; each class is a node of its own, named after its least id.
    classes = checkpointed(rows.where(able).groupBy(F.col(label).alias("label"), F.col(vector).alias("vector")).agg(F.min(vec_id).alias("node"), F.count("*").alias("copies")))
    model = train(classes, s)
    keep = rows.withColumn("_able", able)
    if model is None:
        none = keep.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col(vec_id).cast("long")})
        return none.withColumn("kept", F.lit(True)).drop("_able")
    found = checkpointed(searched(dealt(classes, model, s), model, s))
    links = found.where("n is not null").groupBy("node").agg(F.sum("n").alias("n"))
    joined = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.join(links, "node", "left").join(joined, "node", "left")
    named = named.select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("_n"), F.coalesce("component", "node").alias("_component"))
    out = keep.join(named, F.col("_able") & (F.col(label) == F.col("_label")) & (F.col(vector) == F.col("_vector")), "left")
    out = out.withColumns({"n_links": F.coalesce("_n", F.lit(0)).cast("long"), "component_id": F.coalesce("_component", F.col(vec_id)).cast("long")})
    return out.withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id"))).drop("_able", "_label", "_vector", "_n", "_component")
