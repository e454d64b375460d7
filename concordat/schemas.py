"""The two document kinds, by fixed columns, and errors about them."""

from __future__ import annotations

# The columns of both kinds, in order.
POSITION_COLUMNS = ["document_id", "position_id", "page_or_sheet", "work_description", "unit", "quantity", "unit_price", "norm_ref"]
REQUISITE_COLUMNS = ["document_id", "page_or_sheet", "entity_name", "bin", "legal_address", "bank_name", "bik", "account_number"]
COLUMNS = {"estimate": POSITION_COLUMNS, "requisite": REQUISITE_COLUMNS}
NUMBERS = ("quantity", "unit_price")
KINDS = {"estimate": "позиции работ", "requisite": "реквизиты"}


class SchemaError(ValueError):
    """A document lacks columns or rows, or holds values that its kind doesn't allow."""

