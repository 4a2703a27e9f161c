"""Measures of a whole Arrow batch of meshes as flat arrays, one pass for all its corners.

Sums run in the order of the corners, as a fold over one mesh would.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _lengths(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _field(structs: pa.StructArray, name: str) -> pa.Array:
    return structs.flatten()[structs.type.get_field_index(name)]


def _number(values: pa.Array) -> np.ndarray:
    return values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)


class Batch:
    """Corners of a batch's meshes: coordinates, and to which ring and mesh each belongs."""

    def __init__(self, meshes: pa.Array):
        self.known = meshes.is_valid().to_numpy(zero_copy_only=False)
        self.size = len(meshes)
        sem, rings = (_field(meshes.flatten(), name) for name in ("sem", "ring"))
        self.sem = sem.fill_null(-1).to_numpy(zero_copy_only=False)
        self.mesh_of_ring = np.repeat(np.arange(self.size), _lengths(meshes))
        self.ring_size = _lengths(rings)
        self.ring_start = np.cumsum(self.ring_size) - self.ring_size
        points = [_field(rings.flatten(), name) for name in "xyz"]
        self.xyz = [_number(c) + 0.0 for c in points]
        self.ring = np.repeat(np.arange(len(self.ring_size)), self.ring_size)
        self.mesh = self.mesh_of_ring[self.ring]
        self.is_last = np.zeros(len(self.ring), dtype=bool)
        self.is_last[(self.ring_start + self.ring_size - 1)[self.ring_size > 0]] = True
        #: Meshes that are there and whose coordinates all are.
        self.whole = self.known.copy()
        for c in points:
            if c.null_count:
                self.whole[self.mesh[~c.is_valid().to_numpy(zero_copy_only=False)]] = False

    def vertices(self) -> np.ndarray:
        """A number per corner; corners of one mesh at one place share it."""
        code = self.mesh
        for c in self.xyz:
            bits = np.where(np.isnan(c), np.nan, c).view(np.int64)
            place, places = pd.factorize(bits)
            code = pd.factorize(code * len(places) + place)[0]
        return code

    def triangles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ring, first corner, middle corner) of every triangle of the fans; the third corner follows the middle one."""
        count = np.maximum(self.ring_size - 3, 0)
        ring = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(ring)) - np.repeat(np.cumsum(count) - count, count)
        start = self.ring_start[ring]
        return ring, start, start + 1 + step

    def face_areas(self) -> np.ndarray:
        """Length of each ring's vector area; under three points gives 0."""
        ring, a, b = self.triangles()
        u, v = ([c[corner] - c[a] for c in self.xyz] for corner in (b, b + 1))
        square = np.zeros(len(self.ring_size))
        parts = []
        for i, j in ((1, 2), (2, 0), (0, 1)):
            parts.append(_summed(ring, [u[i] * v[j], -(u[j] * v[i])], len(square)))
        for p in parts:
            square = square + p * p
        return np.sqrt(square) / 2

    def areas(self, sem: int) -> np.ndarray:
        of_kind = self.sem == sem
        return _summed(self.mesh_of_ring[of_kind], [self.face_areas()[of_kind]], self.size)

    def volumes(self) -> np.ndarray:
        """Volume enclosed by outward faces, with coordinates taken from the first vertex."""
        ring, a, b = self.triangles()
        of_mesh = self.mesh_of_ring[ring]
        first = np.full(self.size, -1)
        first[self.mesh_of_ring[::-1]] = self.ring_start[::-1]
        origin = first[of_mesh]
        (ax, ay, az), (bx, by, bz), (cx, cy, cz) = ([c[corner] - c[origin] for c in self.xyz] for corner in (a, b, b + 1))
        return np.abs(_summed(of_mesh, [ax * (by * cz - bz * cy), ay * (bz * cx - bx * cz), az * (bx * cy - by * cx)], self.size)) / 6

    def vertex_counts(self) -> np.ndarray:
        return self._count_vertices(self.vertices())

    def _count_vertices(self, vertex: np.ndarray) -> np.ndarray:
        inner = ~self.is_last
        seen = ~pd.Series(vertex[inner]).duplicated().to_numpy()
        return np.bincount(self.mesh[inner][seen], minlength=self.size)

    def checks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vertices, directed edges without their reverse, and whether an edge repeats or a face has no area."""
        vertex = self.vertices()
        start = np.flatnonzero(~self.is_last)
        total = int(vertex.max()) + 1 if len(vertex) else 1
        a, b, mesh = vertex[start], vertex[start + 1], self.mesh[start]
        edge = a * total + b
        repeated = pd.Series(edge).duplicated().to_numpy()
        alone = ~repeated & ~pd.Series(edge).isin(b * total + a).to_numpy()
        non_manifold, degenerate = np.zeros(self.size, dtype=bool), np.zeros(self.size, dtype=bool)
        non_manifold[mesh[repeated]] = True
        degenerate[self.mesh_of_ring[self.face_areas() <= 0]] = True
        return self._count_vertices(vertex), np.bincount(mesh[alone], minlength=self.size), non_manifold, degenerate


def _summed(place: np.ndarray, terms: list[np.ndarray], size: int) -> np.ndarray:
    """Sums by place; the terms of one position are added one after the other before the next position's."""
    return np.bincount(np.repeat(place, len(terms)), weights=np.stack(terms, axis=1).ravel(), minlength=size)


def _column(measure: Callable[[Batch], np.ndarray], kind: str) -> Callable[[Column], Column]:
    @F.arrow_udf(kind)
    def run(faces: pa.Array) -> pa.Array:
        batch = Batch(faces)
        return pa.array(measure(batch), mask=~(batch.known if kind == "int" else batch.whole))

    return run


QUALITY = "struct<n_vertices:int,open_edges:int,codes:array<string>>"


def _quality(faces: pa.Array) -> pa.Array:
    batch = Batch(faces)
    n_vertices, open_edges, non_manifold, degenerate = batch.checks()
    found = np.stack([open_edges > 0, non_manifold, degenerate], axis=1)
    names = np.array(["open_edge", "non_manifold", "degenerate_face"], dtype=object)
    codes = pa.ListArray.from_arrays(np.r_[0, np.cumsum(found.sum(axis=1))].astype(np.int32), pa.array(names[np.nonzero(found)[1]], pa.string()))
    return pa.StructArray.from_arrays([pa.array(n_vertices.astype(np.int32)), pa.array(open_edges.astype(np.int32)), codes],
                                      ["n_vertices", "open_edges", "codes"], mask=pa.array(~batch.known))


def quality(faces: Column) -> Column:
    # not deterministic: a filter on the verdict shall not run it once more, before the meshes are dealt to tasks
    return F.arrow_udf(_quality, QUALITY).asNondeterministic()(faces)


def vertex_count(faces: Column) -> Column:
    return _column(lambda b: b.vertex_counts().astype(np.int32), "int")(faces)


def closed_volume(faces: Column) -> Column:
    return _column(Batch.volumes, "double")(faces)


def surface_area(faces: Column, sem: int) -> Column:
    return _column(lambda b: b.areas(sem), "double")(faces)
