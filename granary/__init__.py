"""Self-describing columnar tables on Spark, with exact predicates and positions."""

from .errors import (
    ConformanceError, FillValueError, FilterError, GranaryError, OversizedStringError, ReservedNameError, SchemaError, StaleIndexError, VersionError,
)
from .functions.specs import ColumnSpec, Deflate, Fletcher32, LeafValues, ListColumnSpec, NestedList, Shuffle, StringValues, TableSpec
from .functions.types import FixedString, Opaque, is_missing, opaque_fill_bytes, recommended_fill, validate_fill_outside_range
from .plans.expr import Expression, Field, field
from .plans.plan import LeafPlan, QueryPlan
from .sources.arrow_io import specs_from_arrow
from .sources.frame import Column, ListColumn, Reader, Selection, over
from .sources.store import Table

__all__ = [
    "Column", "ColumnSpec", "ConformanceError", "Deflate", "Expression", "Field", "FillValueError", "FilterError", "FixedString", "Fletcher32", "GranaryError",
    "LeafPlan", "LeafValues", "ListColumn", "ListColumnSpec", "NestedList", "Opaque", "OversizedStringError", "QueryPlan", "Reader", "ReservedNameError",
    "SchemaError", "Selection", "Shuffle", "StaleIndexError", "StringValues", "Table", "TableSpec", "VersionError", "field", "is_missing",
    "opaque_fill_bytes", "over", "recommended_fill", "specs_from_arrow", "validate_fill_outside_range",
]
