"""The small block mesh: 27 nodes on a lattice, 40 tetrahedra in two tags, and nodal data."""

from trellis.model import Mesh

# fixed values: connectivity and data of the fixture
CON = """0 1 3 9 | 3 1 4 13 | 1 9 10 13 | 1 3 9 13 | 9 3 12 13 | 1 2 5 11 | 4 1 5 13 | 5 1 11 13
1 10 11 13 | 11 5 13 14 | 3 4 7 13 | 6 3 7 15 | 7 3 13 15 | 3 12 13 15 | 13 7 15 16 | 4 5 7 13
7 5 8 17 | 5 13 14 17 | 5 7 13 17 | 13 7 16 17 | 9 10 13 19 | 12 9 13 21 | 13 9 19 21 | 9 18 19 21
19 13 21 22 | 10 11 13 19 | 13 11 14 23 | 11 19 20 23 | 11 13 19 23 | 19 13 22 23 | 12 13 15 21 | 15 13 16 25
13 21 22 25 | 13 15 21 25 | 21 15 24 25 | 13 14 17 23 | 16 13 17 25 | 17 13 23 25 | 13 22 23 25 | 23 17 25 26"""
ROWS = [[int(x) for x in row.split()] for row in CON.replace("\n", " | ").split("|")]


def block(spark) -> Mesh:
    nodes = [(i + 3 * j + 9 * k, -500.0 + 500 * i, -500.0 + 500 * j, -500.0 + 500 * k) for k in range(3) for j in range(3) for i in range(3)]
    elements = [(e, "Tt", con, 1 if e < 24 else 2, [1.0, 0.0, 0.0]) for e, con in enumerate(ROWS)]
    return Mesh(spark.createDataFrame(nodes, "nid long, x double, y double, z double"), spark.createDataFrame(elements, "eid long, etype string, con array<long>, tag long, fib array<double>"))
