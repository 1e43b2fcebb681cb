"""Refusals by name. Each says what was wrong with what was asked; none is a bare arithmetic failure."""

from __future__ import annotations

import math


class Refusal(ValueError):
    """Something this engine declines to compute, with the reason."""


class GridRefusal(Refusal):
    """The grid asked for cannot be made."""


class CrsRefusal(Refusal):
    """The coordinates are not metres of a known projection."""


class ReadRefusal(Refusal):
    """A file or table of returns cannot be trusted."""


class EmptyFolder(ReadRefusal):
    """There is nothing to read."""


class FilterRefusal(Refusal):
    """A ground filter was given lengths or a surface it cannot work on."""


class BasisRefusal(Refusal):
    """No basis can be assigned."""


class StampRefusal(Refusal):
    """An acquisition stamp does not name an instant."""


class CatalogueRefusal(Refusal):
    """A catalogue document is not shaped as one."""


class SelectionRefusal(CatalogueRefusal):
    """The tiles on offer do not make an area to work on."""


class NotSelected(SelectionRefusal):
    """A tile was read that the selection does not name."""


class PrecheckRefusal(Refusal):
    """The data cannot support the product asked for."""


class RecordRefusal(Refusal):
    """The record is not one to publish."""


class RenderRefusal(Refusal):
    """A band cannot be drawn without inventing something."""


class CompareRefusal(Refusal):
    """Two runs or two files cannot be compared."""


class AoiRefusal(Refusal):
    """An area-of-interest document does not say where it is."""


def length(name: str, value: float, error: type[Refusal], zero: bool = False) -> float:
    """`value` if it is a finite length in metres above zero (or zero, where that is allowed)."""
    if not math.isfinite(value) or value < 0 or (value == 0 and not zero):
        raise error(f"{name} must be a {'non-negative' if zero else 'positive'}, finite length in metres, got {value}")
    return float(value)
