"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from basinflow.plans import files, generators, grids, ligands, strings, ways
from basinflow.streaming import flood

QUERIES: dict = {**grids.QUERIES, **strings.QUERIES, **files.QUERIES, **ways.QUERIES, **generators.QUERIES, **ligands.QUERIES, **flood.QUERIES}
SQL: dict[str, str] = {**grids.SQL, **strings.SQL, **files.SQL, **ways.SQL, **generators.SQL, **ligands.SQL, **flood.SQL}
