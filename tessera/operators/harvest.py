"""From the cells of annexes to loans, properties and observations: the phases in order, each written before the next reads it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from ..sources.stage import staged
from . import annex, extract


class Harvest:
    """Tables of all documents: stacked cells with the kinds of their rows, the joined table, what it says, and the properties.

    A phase runs when it is first asked for: who wants the properties needs no joined table.
    """

    def __init__(self, cells: DataFrame):
        self._given = cells

    @cached_property
    def _stacked(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        cells = staged(annex.merge_headers(self._given), "annex-merged")
        headers = staged(extract.header_rows(cells), "annex-headers")
        mapping = staged(extract.map_columns(cells, headers), "annex-mapping")
        cells = staged(annex.attach_continuations(cells, headers, mapping), "annex-attached")
        # Owners keep their place, so their header rows hold.
        headers = staged(extract.header_rows(cells), "annex-headers")
        stacked, tops = annex.stack_pages(cells, headers)
        cells, headers = staged(stacked, "annex-stacked"), staged(tops, "annex-headers")
        return cells, headers, staged(extract.map_columns(cells, headers), "annex-mapping")

    @property
    def cells(self) -> DataFrame:
        return self._stacked[0]

    @cached_property
    def kinds(self) -> DataFrame:
        return staged(annex.split_rows(*self._stacked), "annex-kinds")

    @cached_property
    def _joined(self) -> tuple[DataFrame, DataFrame]:
        cells, headers, mapping = self._stacked
        loans = staged(annex.loan_cells(cells, headers, self.kinds), "annex-loans")
        joined, top = annex.join_tables(loans, headers, mapping)
        return staged(joined, "annex-joined"), staged(top, "annex-headers")

    @property
    def joined(self) -> DataFrame:
        return self._joined[0]

    @property
    def joined_headers(self) -> DataFrame:
        return self._joined[1]

    @cached_property
    def joined_mapping(self) -> DataFrame:
        return staged(extract.map_columns(self.joined, self.joined_headers), "annex-mapping")

    @cached_property
    def observations(self) -> DataFrame:
        return staged(annex.route_units(extract.observations(self.joined, self.joined_mapping)), "annex-observations")

    @cached_property
    def properties(self) -> DataFrame:
        cells, _, mapping = self._stacked
        rows = self.kinds.where("kind = 'property'").select(*annex.ROW)
        # Only the rows of properties are read for them.
        own = staged(cells.join(rows, annex.ROW, "left_semi"), "annex-property-cells")
        return annex.properties(annex.route_units(extract.observations(own, mapping)), own, self.kinds)


def harvest(cells: DataFrame) -> Harvest:
    """cells: doc_id, table_idx, row_idx, col_idx, text, as html_cells gives them."""
    return Harvest(cells)
