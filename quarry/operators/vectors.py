"""Vector analytics: threshold search, gallery ranking, complete-link clusters, mutual best matches, suppression."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.geometry import cosine_to, vector_is_valid
from quarry.tables import kept, partitions

MARGIN = 0.05
LIKE = 0.5
#: Rows on a side of a large tile, cells of it compared at once, pairs summed at once; cells of a folder compared at once; faces of a cluster with a list.
SIDE, CELLS, CHUNK, BLOCK, LISTED = 32768, 1 << 22, 1 << 16, 1 << 19, 4


def search(features: DataFrame, query: list[float], threshold: float, current: DataFrame | None = None, valid_only: bool = True) -> DataFrame:
    """Features at or over the threshold with their similarity; with current (asset_path, source_revision), stale rows are left out first.

    Exhaustive by contract: every vector is compared, in its own task, with the one query vector.
    """
    rows = features.where(vector_is_valid(F.col("vector"))) if valid_only else features
    if current is not None:
        rows = rows.join(current.select("asset_path", "source_revision"), ["asset_path", "source_revision"], "left_semi")
    return rows.withColumn("similarity", cosine_to(F.col("vector"), query)).where(F.col("similarity") >= threshold)


def search_page(found: DataFrame, offset: int, limit: int) -> DataFrame:
    return found.orderBy(F.col("similarity").desc(), "asset_path", "instance_id", "feature_row_id").offset(offset).limit(min(max(limit, 1), 1000))


def space_contracts(features: DataFrame) -> DataFrame:
    """(feature_space_id, producer, dimension, conflicts): the first row of a space sets its contract; conflicts counts rows that break it."""
    first = features.groupBy("feature_space_id").agg(F.min_by(F.struct(F.col("pipeline_fingerprint").alias("producer"), F.size("vector").alias("dimension")), "feature_row_id").alias("c"))
    joined = features.join(first, "feature_space_id")
    broken = (F.col("pipeline_fingerprint") != F.col("c.producer")) | (F.size("vector") != F.col("c.dimension"))
    return joined.groupBy("feature_space_id", "c.producer", "c.dimension").agg(F.count_if(broken).alias("conflicts"))


def gallery_scores(faces: DataFrame, references: DataFrame, threshold: float) -> DataFrame:
    """(face_id, person_id, score): each face's best score with each person, where it reaches the threshold.

    Faces and references, of which equal ones count once, are dealt out in tiles of so many by so many; a tile is one task's products of matrices, and only its best
    scores leave it. Both are counted first: what a row is copied for grows with the other side, so that large tables have larger tiles.
    """
    spark = faces.sparkSession
    typed = lambda df: df if df.schema["vector"].dataType.elementType.simpleString() in ("float", "double") else df.withColumn("vector", F.col("vector").cast("array<double>"))
    faces, references = typed(faces.select("face_id", "vector")), typed(kept(references.select("person_id", "vector").distinct(), "references"))  # the latter counted, then read
    n, m = faces.count(), references.count()
    rows, columns = -(-n // (SIDE if n > SIDE * partitions(spark) else SIDE // 8)), -(-m // SIDE)
    part = lambda k, *of: F.pmod(F.xxhash64(*of), F.lit(max(k, 1))).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(max(k, 1) - 1)))
    left = faces.select(part(rows, "face_id", "vector").alias("i"), every(columns).alias("j"), "face_id", "vector")
    right = references.select(every(rows).alias("i"), part(columns, "person_id", "vector").alias("j"), "person_id", F.lit(True).alias("known"), "vector")
    face, person = (df.schema[c].dataType.simpleString() for df, c in ((faces, "face_id"), (references, "person_id")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        known = pc.is_valid(table.column("known"))
        f, r = (table.filter(c) for c in (pc.invert(known), known))
        codes = r.column("person_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        of = [_by_length(t.column("vector").combine_chunks()) for t in (f, r)]
        for size in of[0].keys() & of[1].keys():
            (i, a), (j, b) = (x[size] for x in of)
            for k, p, score in best_scores(a, b, codes[j], threshold):
                columns = [f.column("face_id").take(pa.array(i[k])).combine_chunks(), r.column("person_id").take(pa.array(j[p])).combine_chunks(), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["face_id", "person_id", "score"])

    tiles = left.unionByName(right, allowMissingColumns=True).groupBy("i", "j")
    best = tiles.applyInArrow(task, f"face_id {face}, person_id {person}, score double")
    return best.repartition("face_id").groupBy("face_id", "person_id").agg(F.max("score").alias("score"))  # dealt out once, for a ranking too


def _by_length(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The vectors of each length without NaN or null, which have no score: their places, and a row for each."""
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy()
    found = {}
    for n in set(sizes.tolist()) - {-1}:
        at = np.flatnonzero(sizes == n)
        values = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
        there = ~np.isnan(values).any(axis=1)
        found[n] = at[there], values[there]
    return found


def front_to_end(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The dot products of a's rows i with b's rows j, summed as dot() does. A product of matrices sums in an order of its own, which its size decides."""
    total = np.zeros(len(i))
    for at in range(0, len(i), CHUNK):
        x, y = np.ascontiguousarray(a[i[at : at + CHUNK]].T), np.ascontiguousarray(b[j[at : at + CHUNK]].T)
        with np.errstate(invalid="ignore", over="ignore"):
            for u, v in zip(x, y, strict=True):
                total[at : at + CHUNK] += u * v
    return total


def tamed(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in single precision, and which are zero there, since their sums could overflow."""
    wild = ~(np.abs(a) < 1e15).all(axis=1)
    return np.where(wild[:, None], 0.0, a).astype(np.float32), wild


def doubt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far, at most, products of a row of a with any of b's, in single precision and any order, can lie from the sums, with room for rounding them."""
    length = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    return length(a) * length(b).max(initial=0.0) * (a.shape[1] + 4) * 2.0**-22 + 1e-30


def best_scores(a: np.ndarray, b: np.ndarray, person: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, scores): the best score of each row of a with each person of b's rows, where it reaches the threshold, a few rows at a time.

    A product of matrices chooses the pairs that can be best, within doubt; what counts are those pairs' sums from front to end.
    """
    if not len(a) or not len(b):
        return
    order = np.argsort(person, kind="stable")
    first = np.flatnonzero(np.diff(person[order], prepend=-1))
    times = np.diff(first, append=len(order))
    (tame, wild), (tame_b, wild_b) = tamed(a), tamed(b[order])
    off = doubt(tame, tame_b)
    step = max(1, CELLS // len(order))
    for at in range(0, len(a), step):
        s = tame[at : at + step] @ tame_b.T
        s[wild[at : at + step]] = s[:, wild_b] = -np.inf
        least = np.maximum(np.maximum.reduceat(s, first, axis=1), threshold) - 2 * off[at : at + step, None]
        near = s >= np.repeat(least.astype(np.float32), times, axis=1)
        near[wild[at : at + step]] = near[:, wild_b] = True
        i, k = np.nonzero(near)
        score = front_to_end(a, b, i + at, order[k])
        good = score >= threshold
        i, k, score = i[good] + at, order[k[good]], score[good]
        if len(i):
            new = np.flatnonzero((np.diff(i, prepend=-1) != 0) | (np.diff(person[k], prepend=-1) != 0))
            yield i[new], k[new], np.maximum.reduceat(score, new)


def rank_open(faces: DataFrame, scores: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(face_id, person_id, score) for every face: the best person, or none where nobody reaches the threshold or the second is within the margin."""
    w = Window.partitionBy("face_id").orderBy(F.col("score").desc(), "person_id")
    best = scores.withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("place = 1")
    clear = best.where(F.col("next").isNull() | (F.col("score") - F.col("next") >= margin)).select("face_id", "person_id", "score")
    return faces.select("face_id").join(clear, "face_id", "left")


def complete_link(faces: DataFrame, folder: str = "folder_path", threshold: float = LIKE, most: int | None = None) -> DataFrame:
    """(folder, asset_path, instance_id, cluster_id): clusters in which every two faces reach the threshold, strongest pairs first; null for faces alone.

    Two faces of one picture are never in one cluster. Merging depends on its order, so a folder is one task's work, in time quadratic in its faces, without a table of
    their pairs; where `most` is given, a folder of more faces is an error. faces: folder, asset_path, instance_id, quality, vector (null where unusable).
    """
    kinds = {f.name: f.dataType.simpleString() for f in faces.schema}

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        if most is not None and len(pdf) > most:
            raise ValueError(f"a folder has {len(pdf)} faces; {most} is the most")
        pdf = pdf.sort_values(["quality", "asset_path", "instance_id"], ascending=[False, True, True], ignore_index=True)
        owners = link([None if v is None else np.asarray(v, np.float64) for v in pdf["vector"]], pdf["asset_path"].tolist(), threshold)
        members: dict[int, list] = {}
        for owner, *face in zip(owners, pdf["asset_path"], pdf["instance_id"], strict=True):
            members.setdefault(owner, []).append(face)
        names = {owner: hashlib.sha256(json.dumps(sorted(m)).encode()).hexdigest() if len(m) > 1 else None for owner, m in members.items()}
        pdf["cluster_id"] = [names[o] for o in owners]
        return pdf[[folder, "asset_path", "instance_id", "cluster_id"]]

    spark = faces.sparkSession
    # a folder is much work and few bytes: few to a partition, and not put together
    dealt = faces.select(folder, "asset_path", "instance_id", "quality", "vector").repartition(max(partitions(spark), 8 * spark.sparkContext.defaultParallelism), folder)
    return dealt.groupBy(folder).applyInPandas(work, f"{folder} {kinds[folder]}, asset_path {kinds['asset_path']}, instance_id {kinds['instance_id']}, cluster_id string")


def link(vectors: list[np.ndarray | None], pictures: list, threshold: float) -> list[int]:
    """The owner of each face: going through the pairs from the strongest on (ties: by i, then j, i > j), two clusters merge where all pairs across them reach the threshold.

    Clusters whose strongest pairs with any they could merge with are one and the same merge in any case: what else merges takes pairs from them and gives none. So
    rounds of such merges end in the same clusters, and only strongest pairs are kept. Clusters of LISTED faces or more keep a list of the faces they can take, which
    their merges shorten, so that those cost what is added. Similarities are summed front to end, in double precision.
    """
    faces = _Faces(vectors, pictures, threshold)
    n = len(vectors)
    owner, live, best = np.arange(n), np.ones(n, bool), np.zeros((n, 2), np.int64)
    need, lists = np.arange(n), {}
    while True:
        order, size = np.argsort(owner, kind="stable"), np.bincount(owner, minlength=n)
        first = np.cumsum(size) - size
        listed = np.array([k in lists for k in need.tolist()], bool)
        for k in need[listed].tolist():
            pair, lists[k] = faces.strongest_listed(k, order[first[k] : first[k] + size[k]], lists[k], owner, size)
            live[k] = pair is not None
            if pair is not None:
                best[k] = pair
            else:
                del lists[k]
        for ids, found, pairs in faces.strongest(need[~listed], np.flatnonzero(live), order, first, size, lists):
            live[ids], best[ids] = found, pairs
        have = np.flatnonzero(live)
        if not len(have):
            return owner.tolist()
        ends = owner[best[have]]
        toward = np.zeros(n, np.int64)
        toward[have] = np.where(ends[:, 0] == have, ends[:, 1], ends[:, 0])
        stays = have[(best[toward[have]] == best[have]).all(axis=1) & (have < toward[have])]
        goes = toward[stays]
        other = np.full(n, -1)  # what a cluster of this round merges with
        other[stays], other[goes] = goes, stays
        rest = have[(other[have] < 0) & (other[toward[have]] >= 0)]
        added = other[toward[rest]]
        k, t, u = _across(size[rest], size[added])
        apart = rest[np.unique(k[faces.similarity(order[first[rest[k]] + t], order[first[added[k]] + u]) < threshold])]
        for one, two in zip(stays.tolist(), goes.tolist(), strict=True):
            if one in lists or two in lists:
                own = (order[first[k] : first[k] + size[k]] for k in (one, two))
                lists[one] = faces.joined(lists.get(one), lists.pop(two, None), *own)
        renamed = np.arange(n)
        renamed[goes] = stays
        owner, live[goes] = renamed[owner], False
        need = np.concatenate([stays, apart])


def _across(size: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, t, u): of every k, each t below its size with each u below its other size."""
    cells = size * other
    k = np.repeat(np.arange(len(cells)), cells)
    at = np.arange(len(k)) - (np.cumsum(cells) - cells)[k]
    return k, at // other[k], at % other[k]


class _Members:
    """Clusters, the largest first, and their faces: all first members, all second ones and so on, so that a cluster's values fold by whole stretches."""

    def __init__(self, ids: np.ndarray, order: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        self.ids, self.size = ids, size[ids]
        self.counts = np.searchsorted(-self.size, -np.arange(self.size.max(initial=1)))  # clusters with a member in each stretch
        self.stretch = np.cumsum(self.counts) - self.counts
        self.faces = np.concatenate([order[first[ids[:m]] + t] for t, m in enumerate(self.counts)])
        self.cluster = np.concatenate([np.arange(m) for m in self.counts])

    def fold(self, f: np.ufunc, values: np.ndarray) -> np.ndarray:
        """A row for each cluster of values, which has a row for each face."""
        if len(self.counts) == 1:
            return values
        out = values[: self.counts[0]].copy()
        for at, m in zip(self.stretch[1:], self.counts[1:], strict=True):
            f(out[:m], values[at : at + m], out=out[:m])
        return out


class _Faces:
    """A folder's faces and how alike they are: -1 within a picture and where a vector is unusable."""

    def __init__(self, vectors: list[np.ndarray | None], pictures: list, threshold: float) -> None:
        self.threshold = threshold
        self.unusable = np.array([v is None for v in vectors])
        nothing = np.zeros(next((len(v) for v in vectors if v is not None), 0))
        self.vectors = np.stack([nothing if v is None else v for v in vectors])
        self.tame, wild = tamed(self.vectors)
        self.off = doubt(self.tame, self.tame) if not wild.any() else np.full(len(wild), np.inf)
        self.picture = pd.factorize(np.array(pictures, object), use_na_sentinel=False)[0].astype(np.int32)
        self.kind = np.unique(self.vectors, axis=0, return_inverse=True)[1].ravel()  # equal vectors are of one kind

    def similarity(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        same = (self.picture[i] == self.picture[j]) | self.unusable[i] | self.unusable[j]
        summed = front_to_end(self.vectors, self.vectors, i, j)
        return np.where(same, -1.0, np.where(np.isnan(summed), -np.inf, summed))

    def products(self, c: np.ndarray, r: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """How alike faces c (rows) and r (columns) are, within their doubt."""
        like = (self.tame[c] if table is None else table) @ self.tame[r].T
        np.copyto(like, -1.0, where=self.picture[c][:, None] == self.picture[r])
        if self.unusable.any():
            like[self.unusable[c]] = like[:, self.unusable[r]] = -1.0
        return like

    def joined(self, one: tuple | None, two: tuple | None, own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list, (faces, similarities to their most alike member), of two clusters together; one of them may have none, but members."""
        if one is not None and two is not None:
            at, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
            return at, np.maximum(one[1][i], two[1][j])
        (at, most), r = (one, others) if two is None else (two, own)
        like = self.products(at, r)
        fits = like >= self.threshold - self.off[r]
        i, j = np.nonzero(fits & (like <= self.threshold + self.off[r]))
        fits[i, j] = self.similarity(at[i], r[j]) >= self.threshold
        stay = fits.all(axis=1)
        return at[stay], np.maximum(most, like.max(axis=1))[stay]

    def strongest_listed(self, cluster: int, members: np.ndarray, listed: tuple, owner: np.ndarray, size: np.ndarray) -> tuple[tuple[int, int] | None, tuple]:
        """The cluster's strongest pair, from its list, and the list of the clusters that are wholly in it."""
        at, most = listed
        ids, back, count = np.unique(owner[at], return_inverse=True, return_counts=True)
        whole = ((count == size[ids]) & (ids != cluster))[back]
        at, most = at[whole], most[whole]
        if not len(at):
            return None, (at, most)
        limit = most.max() - 2 * self.off[members].max()
        # of faces of one kind the first ones make the pair that comes first
        c, r = (x[np.unique(self.kind[x], return_index=True)[1]] for x in (np.sort(at[most >= limit]), members))
        k, m = np.nonzero(self.products(c, r) >= limit)
        i, j = np.maximum(c[k], r[m]), np.minimum(c[k], r[m])
        head = np.lexsort((j, i, -self.similarity(i, j)))[0]
        return (i[head], j[head]), (at, most)

    def strongest(self, ids: np.ndarray, all_ids: np.ndarray, order: np.ndarray, first: np.ndarray, size: np.ndarray, lists: dict[int, tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(clusters, whether there is one, (i, j)): each cluster's strongest pair with a cluster of all_ids that it can merge with, a few clusters at a time.

        Clusters of LISTED faces or more are put into lists.
        """
        if not len(ids):
            return
        ids, all_ids = (k[np.argsort(-size[k], kind="stable")] for k in (ids, all_ids))
        columns = _Members(all_ids, order, first, size)
        place = np.zeros(len(size), np.int64)
        place[all_ids] = np.arange(len(all_ids))
        table = self.tame[columns.faces]
        parts = np.cumsum(size[ids]) * len(table) // BLOCK
        for part in np.split(ids, np.flatnonzero(np.diff(parts)) + 1):
            rows = _Members(part, order, first, size)
            found, pairs = self._strongest(rows, columns, table, place[part], lists)
            yield part, found, pairs

    def _strongest(self, rows: _Members, columns: _Members, table: np.ndarray, own: np.ndarray, lists: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Products of matrices choose, within doubt; pairs in doubt are summed from front to end. A column of the products is a face of rows."""
        like = self.products(columns.faces, rows.faces, table)
        least, most = (rows.fold(f, columns.fold(f, like).T).T for f in (np.minimum, np.maximum))
        off = rows.fold(np.maximum, self.off[rows.faces])
        fits = least >= (self.threshold - off).astype(np.float32)
        fits[own, np.arange(len(own))] = False
        g, a = np.nonzero(fits & (least <= (self.threshold + off).astype(np.float32)))
        k, t, u = _across(rows.size[a], columns.size[g])
        low = self.similarity(rows.faces[rows.stretch[t] + a[k]], columns.faces[columns.stretch[u] + g[k]]) < self.threshold
        fits[g[k[low]], a[k[low]]] = False
        for k in np.flatnonzero((rows.size >= LISTED) & fits.any(axis=0)) if self.threshold > -1 else ():
            at = np.flatnonzero(fits[columns.cluster, k])
            lists[int(rows.ids[k])] = columns.faces[at], like[np.ix_(at, rows.stretch[: rows.size[k]] + k)].max(axis=1)
        strong = np.where(fits, most, np.float32(-np.inf))
        limit = (strong.max(axis=0) - 2 * off).astype(np.float32)
        g, a = np.nonzero(fits & (strong >= limit))
        k, t, u = _across(rows.size[a], columns.size[g])
        r, c = rows.stretch[t] + a[k], columns.stretch[u] + g[k]
        near = like[c, r] >= limit[a[k]]
        r, c = r[near], columns.faces[c[near]]
        # a face's pairs with faces of one kind are equally strong, and that with the first of them comes before the others
        kinds, kind = np.unique(self.kind[c], return_inverse=True)
        one = np.full((len(rows.faces), len(kinds)), len(self.kind))
        np.minimum.at(one, (r, kind.ravel()), c)
        r, kind = np.nonzero(one < len(self.kind))
        r, c, cluster = rows.faces[r], one[r, kind], rows.cluster[r]
        i, j = np.maximum(r, c), np.minimum(r, c)
        by_rank = np.lexsort((j, i, -self.similarity(i, j), cluster))
        heads = by_rank[np.flatnonzero(np.diff(cluster[by_rank], prepend=-1))]
        pairs = np.zeros((len(rows.ids), 2), np.int64)
        pairs[cluster[heads]] = np.stack([i[heads], j[heads]], axis=1)
        return fits.any(axis=0), pairs


def cluster_sizes(clustered: DataFrame, folder: str = "folder_path") -> DataFrame:
    """Clusters, the largest first."""
    return clustered.where("cluster_id IS NOT NULL").groupBy(folder, "cluster_id").agg(F.count("*").alias("size")).orderBy(F.col("size").desc(), "cluster_id")


def mutual_best(pairs: DataFrame, margin: float, group: tuple[str, ...] = ()) -> DataFrame:
    """(group, manual_id, detected_id, score, matched): each manual's best pair, matched where it is the best from both sides and leads both runners-up by the margin."""
    by_manual = Window.partitionBy(*group, "manual_id").orderBy(F.col("score").desc(), "detected_id")
    by_detected = Window.partitionBy(*group, "detected_id").orderBy(F.col("score").desc(), "manual_id")
    ranked = pairs
    for side, w in (("m", by_manual), ("d", by_detected)):
        ranked = ranked.withColumn(f"{side}_place", F.row_number().over(w)).withColumn(f"{side}_next", F.lead("score").over(w))
    clear = lambda c: F.col(c).isNull() | (F.col("score") - F.col(c) >= margin)
    matched = (F.col("d_place") == 1) & clear("m_next") & clear("d_next")
    return ranked.where("m_place = 1").select(*group, "manual_id", "detected_id", "score", matched.alias("matched"))


def align(manual: DataFrame, detected: DataFrame, revision: Column | str, score: Column, margin: float = 0.15, picture: tuple[str, ...] = (), measures: Mapping[str, Column] | None = None) -> DataFrame:
    """(picture, manual_id, detected_id, score, reason): a match, or the reason there is none, for every manual instance.

    manual and detected have id, source_identity_revision, face_box, body_box and the picture's columns (manual also needs_review); revision is the picture's
    current one, a literal or a column of both; score is a column over m and d, or over the measures, which are columns over m and d and are made first.
    Pictures are aligned each by itself.
    """
    revision = F.lit(revision) if isinstance(revision, str) else revision
    reason = (
        F.when(F.coalesce("needs_review", F.lit(False)), "needs_review").when(F.col("source_identity_revision").isNull(), "source_unverified").when(~F.col("source_identity_revision").eqNullSafe(revision), "source_changed")
    )
    judged = manual.withColumn("reason", reason)
    ready, current = judged.where("reason IS NULL").alias("m"), detected.where(F.col("source_identity_revision") == revision).alias("d")
    # one picture's instances on either side: a bounded handful, and a join on the picture and the revision they share
    same = [F.col(f"m.{c}") == F.col(f"d.{c}") for c in (*picture, "source_identity_revision")]
    first = {"score": score} if measures is None else measures
    met = ready.join(current, same).select(*(F.col(f"m.{c}") for c in picture), F.col("m.id").alias("manual_id"), F.col("d.id").alias("detected_id"), *(c.alias(k) for k, c in first.items()))
    pairs = met.select(*picture, "manual_id", "detected_id", (F.col("score") if measures is None else score).alias("score")).where("score IS NOT NULL")
    best = mutual_best(pairs, margin, picture)
    joined = judged.select(*picture, F.col("id").alias("manual_id"), "reason").join(best, [*picture, "manual_id"], "left")
    why = F.coalesce("reason", F.when(F.col("matched").isNull(), "no_matching_detection").when(~F.col("matched"), "ambiguous_geometry"))
    return joined.select(*picture, "manual_id", F.when(F.col("matched"), F.col("detected_id")).alias("detected_id"), F.when(F.col("matched"), F.col("score")).alias("score"), why.alias("reason"))


def suppress(boxes: DataFrame, picture: str, most_overlap: float) -> DataFrame:
    """Non-maximum suppression per picture: boxes (x1, y1, x2, y2, score) best first, kept where no kept one overlaps more; areas count border pixels."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        x1, y1, x2, y2 = (pdf[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2"))
        area = (x2 - x1 + 1) * (y2 - y1 + 1)
        stay: list[int] = []
        for k in range(len(pdf)):
            w = np.maximum(np.minimum(x2[k], x2[stay]) - np.maximum(x1[k], x1[stay]) + 1, 0)
            h = np.maximum(np.minimum(y2[k], y2[stay]) - np.maximum(y1[k], y1[stay]) + 1, 0)
            if (w * h / (area[k] + area[stay] - w * h) <= most_overlap).all():
                stay.append(k)
        return pdf.iloc[stay]

    return boxes.groupBy(picture).applyInPandas(work, boxes.schema)
