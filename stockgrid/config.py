"""Policy constants and source schemas.

Everything in the FIXED VALUES block must equal the source application's
configuration and header contracts; results depend on them. Nothing else in
the package hard-codes a plant, a field name or a threshold.
"""
from __future__ import annotations

import re

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the source application exactly)
# ---------------------------------------------------------------------------

PLANTS = ("2910", "2920", "2930")

PLANT_NAMES = {"2910": "Mississauga", "2920": "Calgary", "2930": "Surrey"}

# open-order field summed into Allocation_Qty, by plant (header names)
ALLOCATION_HEADER_BY_PLANT = {
    "2910": "PO Quantity",
    "2920": "PO Request Quantity",
    "2930": "PO Request Quantity",
}

SAFETY_STOCK_PCT = 0.20

RISK_REVIEW = "Review"
RISK_CRITICAL = "Critical"
RISK_AT_RISK = "At Risk"
RISK_COVERED = "Covered"
ACTION_STATUSES = ("Critical", "At Risk", "Review")
AT_RISK_STATUSES = ("Critical", "At Risk")

# configured supplier order (one export section each, in this order)
SUPPLIERS = (
    "Alimentias", "Cheeseland", "Vergeer", "Woerle", "Freisland", "Caputo",
    "Bothwell", "Cows", "Anne of GG", "AppleKiss", "Sabana", "Stonetown",
    "La Tortilla", "Traditional", "Gay Lea", "Old Croc",
)

CUSTOMER_ORDERS_HEADERS = (
    "Plant", "Sales Order", "Sales Order Type Desc.", "Sold To Name", "Material",
    "TOL Material Description", "Order Quantity", "Confirmed Quantity (CS)",
    "Reason for Rejection Desc.", "Picked Quantity (CS)", "Picked Quantity (KG)",
    "Invoice Quantity (CS)", "Invoice Quantity (KG)", "Item Net Amount",
    "Outbound Delivery #", "Outbound Delivery Status", "BBD / Shelf Life",
    "Item Net Amount (Confirmed)", "Requested Delivery Date", "Ship to Arrive Date",
    "Appointment Confirmation", "Shipped Date", "Vendor", "Vendor Name",
    "Material Group Description", "Purchasing Group", "Purchasing Group Name",
    "BDM Description", "CDM Name", "Credit Check Status", "Credit Check Status Desc.",
)

ON_HAND_HEADERS = (
    "Material", "Material Description", "Plant", "Plant Name", "Storage Location",
    "Stock in Quality Inspection", "Unrestricted Stock", "Batch", "Blocked Stock",
    "Production Date", "Shelf Life Expiration Date",
)

OPEN_ORDERS_HEADERS = (
    "Material", "PO Number", "Open PO Qty", "PO Quantity", "PO Request Quantity",
    "PO Received Qty", "Inbound Delivery Quantity", "Company Code", "Vendor",
    "Vendor Name", "Supplier", "Supplier Name", "Delivery Date", "Est PU Date",
    "Plant", "SLOC", "Material Description", "Material Group", "Delivery Completed",
    "Created On Date", "Appt. Plant", "Gross Weight", "Appt. Date", "Appt. Time",
    "Delivery Date Derived Field", "Delivery Priority Text", "Inbound Delivery Status",
    "STO/CD Pro #",
)

# upload file -> (dataset kind, plant); OH20 is plant 2920
UPLOAD_FILE_MAP = {
    "2910Customerorders.xlsx": ("customer_orders", "2910"),
    "2920CustomerOrders.xlsx": ("customer_orders", "2920"),
    "2930Customerorders.xlsx": ("customer_orders", "2930"),
    "OH2910.xlsx": ("on_hand", "2910"),
    "OH20.xlsx": ("on_hand", "2920"),
    "OH2930.xlsx": ("on_hand", "2930"),
    "OR2910.xlsx": ("open_orders", "2910"),
    "OR2920.xlsx": ("open_orders", "2920"),
    "OR2930.xlsx": ("open_orders", "2930"),
}

IDENTIFIER_HEADERS = {
    "customer_orders": ("Plant", "Sales Order", "Material", "Vendor", "Outbound Delivery #"),
    "on_hand": ("Plant", "Material", "Batch"),
    "open_orders": ("Plant", "Material", "PO Number", "Vendor", "Supplier"),
}

DATE_HEADERS = {
    "customer_orders": ("BBD / Shelf Life", "Requested Delivery Date", "Ship to Arrive Date", "Shipped Date"),
    "on_hand": ("Production Date", "Shelf Life Expiration Date"),
    "open_orders": ("Delivery Date", "Est PU Date", "Created On Date", "Appt. Date", "Delivery Date Derived Field"),
}

NUMERIC_HEADERS = {
    "customer_orders": (
        "Order Quantity", "Confirmed Quantity (CS)", "Picked Quantity (CS)",
        "Picked Quantity (KG)", "Invoice Quantity (CS)", "Invoice Quantity (KG)",
        "Item Net Amount", "Item Net Amount (Confirmed)",
    ),
    "on_hand": ("Stock in Quality Inspection", "Unrestricted Stock", "Blocked Stock"),
    "open_orders": (
        "Open PO Qty", "PO Quantity", "PO Request Quantity", "PO Received Qty",
        "Inbound Delivery Quantity", "Gross Weight",
    ),
}

# master build: header labels on the supplier sheets
MASTER_HEADER_ROW = 3
LABEL_PLANT = "Plant #"
LABEL_SAP = "SAP #"
LABEL_TOL = "TOL #"
LABELS_DESCRIPTION = ("Product", "Item")
SAP_MAX_DISTANCE_FROM_TOL = 3
FORECAST_HEADER_PATTERN = "(?i)forecast|fcst"
ERROR_STRINGS = ("#REF!", "#N/A", "#VALUE!", "#DIV/0!", "#NAME?", "#NULL!", "#NUM!")

# sheet profiling: header keyword tags, in this order
HEADER_TAG_PATTERNS = (
    ("material", r"(?i)material|sap\s*#|sap\s*material"),
    ("tol", r"(?i)\btol\b"),
    ("description", r"(?i)description|desc\.?$"),
    ("vendor", r"(?i)vendor|supplier"),
    ("plant", r"(?i)plant"),
    ("forecast", r"(?i)forecast|fcst"),
    ("target", r"(?i)target|par\s*level|min.?max|reorder"),
    ("safety", r"(?i)safety"),
    ("case_pack", r"(?i)case\s*pack|units?/case|per\s*case"),
    ("on_hand", r"(?i)on\s*hand|unrestricted"),
    ("open_po", r"(?i)open\s*po|on\s*order"),
)
HEADER_SCAN_MAX_ROW = 8
TAG_SAMPLE_ROWS = 15
BROKEN_FORMULA_SAMPLES = 3
BROKEN_FORMULA_CHARS = 200

# reconciliation pass threshold
VARIANCE_TOLERANCE = 1e-6

# ---------------------------------------------------------------------------
# Derived, not fixed: physical column names
# ---------------------------------------------------------------------------

KINDS = ("customer_orders", "on_hand", "open_orders")
HEADERS_BY_KIND = {
    "customer_orders": CUSTOMER_ORDERS_HEADERS,
    "on_hand": ON_HAND_HEADERS,
    "open_orders": OPEN_ORDERS_HEADERS,
}

# headers the grid reads get short physical names; the rest are snake_cased
_SHORT_NAMES = {
    "Plant": "Plant",
    "Material": "Material",
    "Sales Order": "sales_order",
    "Order Quantity": "order_qty",
    "Confirmed Quantity (CS)": "confirmed_qty",
    "Requested Delivery Date": "requested_date",
    "Batch": "batch",
    "Unrestricted Stock": "unrestricted",
    "Stock in Quality Inspection": "quality",
    "Blocked Stock": "blocked",
    "Shelf Life Expiration Date": "expiry",
    "PO Number": "po_number",
    "Open PO Qty": "open_po_qty",
    "PO Quantity": "po_qty",
    "PO Request Quantity": "po_request_qty",
    "Inbound Delivery Quantity": "inbound_qty",
    "Delivery Date": "delivery_date",
}


def physical_name(header: str) -> str:
    """Column name used on disk and in DataFrames for a source header."""
    if header in _SHORT_NAMES:
        return _SHORT_NAMES[header]
    return re.sub(r"[^0-9a-z]+", "_", header.lower()).strip("_")


ALLOCATION_FIELD_BY_PLANT = {p: physical_name(h) for p, h in ALLOCATION_HEADER_BY_PLANT.items()}

# measures per kind that reconciliation and the grid use (physical names)
QUANTITY_FIELDS_BY_KIND = {
    "customer_orders": ("order_qty", "confirmed_qty"),
    "on_hand": ("unrestricted", "quality", "blocked"),
    "open_orders": ("open_po_qty", "po_qty", "po_request_qty", "inbound_qty"),
}
