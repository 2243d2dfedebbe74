"""Declared schemas and the fixed values of the lease-book domain."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
TOTAL = T.DecimalType(14, 2)
PERCENT = T.DecimalType(7, 4)

# ---- fixed values: enumerations --------------------------------------------
DATASETS = ("rent_roll", "unit_availability")
SECTIONS = ("current", "future")
STATUSES = ("occupied", "notice", "vacant", "model", "down", "future")
CHARGE_CATEGORIES = (
    "rent", "subsidy", "concession", "parking", "garage", "storage", "pet", "utility",
    "amenity", "service", "tax", "cam", "insurance", "fee", "other",
)
INSIGHT_SCOPES = ("portfolio", "asset", "property")
INSIGHT_CATEGORIES = (
    "occupancy", "revenue", "concession", "expiration", "delinquency", "unit_mix",
    "data_quality", "trend", "positioning",
)
PRIORITIES = ("low", "medium", "high")

# ---- fixed values: the seeded charge codes (code, category, description, verified) ----
CHARGE_CODES = [
    ("RENT", "rent", "Base rent", True),
    ("RENTAFF", "rent", "Affordable / restricted base rent", True),
    ("RENTRETL", "rent", "Retail / commercial base rent", True),
    ("RENTHAP", "subsidy", "HAP (Section 8) rent portion", True),
    ("SUBSIDY", "subsidy", "Rental subsidy", True),
    ("SEC8CRD", "subsidy", "Section 8 credit", True),
    ("MTM", "fee", "Month-to-month premium", True),
    ("PARKING", "parking", "Parking", True),
    ("CONPARK", "concession", "Parking concession", True),
    ("GARAGE", "garage", "Garage", True),
    ("CONGAR", "concession", "Garage concession", True),
    ("STORAGE", "storage", "Storage", True),
    ("CONSTOR", "concession", "Storage concession", True),
    ("PETFEE", "pet", "Pet fee (one-time)", True),
    ("PETFEEM", "pet", "Pet fee (monthly)", True),
    ("CONPETM", "concession", "Monthly pet concession", True),
    ("AMENITY", "amenity", "Amenity fee", True),
    ("CONAMEN", "concession", "Amenity concession", True),
    ("CONRENT", "concession", "Rent concession", True),
    ("CONEMP", "concession", "Employee rent concession", True),
    ("TRASH", "utility", "Trash / valet trash", True),
    ("WATER", "utility", "Water / sewer", True),
    ("UTILCOM", "utility", "Commercial utility reimbursement", True),
    ("SALESTX", "tax", "Sales tax", True),
    ("RETXEST", "tax", "Real estate tax escrow estimate", True),
    ("CAMEST", "cam", "CAM estimate", True),
    ("CAMINSR", "insurance", "CAM insurance recovery", True),
    ("HOMEPCKG", "service", "Home package bundle (inferred)", False),
    ("SDFEE", "fee", "SD fee (inferred)", False),
    ("W/D", "service", "Washer/dryer rental (inferred)", False),
    ("BIKE", "service", "Bike storage (inferred)", False),
    ("RNTPROF", "other", "Rent profile adjustment (inferred)", False),
]
CHARGE_CODE_SCHEMA = "charge_code string, category string, description string, label_verified boolean"

# ---- fixed values: report layout -------------------------------------------
RENT_ROLL_TITLE = "Rent Roll with Lease Charges"
TITLE_PATTERN = r"^(.+?)\s*\(([^)]+)\)$"
AS_OF_PATTERN = r"^As Of\s*=\s*(\d{2}/\d{2}/\d{4})$"
MONTH_PATTERN = r"^Month Year\s*=\s*(\d{2}/\d{4})$"
RENT_ROLL_HEADER_1 = ("Unit", "Unit Type", "Unit", "Resident", "Name", "Market", "Charge",
                      "Amount", "Resident", "Other", "Move In", "Lease", "Move Out", "Balance")
RENT_ROLL_HEADER_2 = ("", "", "Sq Ft", "", "", "Rent", "Code", "", "Deposit", "Deposit", "",
                      "Expiration", "", "")
RENT_ROLL_COLUMNS = 14
AVAILABILITY_TITLE = "Unit Availability"
AVAILABILITY_HEADER_1 = ("Property", "Name", "Avg.", "Avg.", "Units", "Occupied", "Vacant",
                         "Vacant", "Notice", "Notice", "Avail", "Model", "Down", "Admin",
                         "% Occ", "% Occ", "% Leased", "% Trend")
AVAILABILITY_HEADER_2 = ("", "", "Sq Ft", "Rent", "", "No Notice", "Rented", "Unrented",
                         "Rented", "Unrented", "", "", "", "", "", "w/NonRev", "", "")
AVAILABILITY_COLUMNS = 18
AVAILABILITY_FIELDS = ("property_code", "property_name", "avg_sqft", "avg_rent", "units",
                       "occupied_no_notice", "vacant_rented", "vacant_unrented",
                       "notice_rented", "notice_unrented", "available", "model", "down",
                       "admin", "pct_occ", "pct_occ_w_nonrev", "pct_leased", "pct_trend")
CURRENT_LABEL = "Current/Notice/Vacant Residents"
FUTURE_LABEL = "Future Residents/Applicants"
SUMMARY_GROUP_LABELS = (CURRENT_LABEL, FUTURE_LABEL, "Occupied Units", "Total Non Rev Units",
                        "Total Vacant Units", "Totals:")
SENTINELS = ("VACANT", "MODEL", "DOWN")
RESIDENT_ID_PATTERN = "^t[A-Za-z0-9]+$"

# ---- fixed values: outlier metrics (metric, label, unit, worse_when) --------
METRICS = [
    ("pct_occupied", "Physical occupancy", "pct", "low"),
    ("revenue_capture_pct", "Revenue capture", "pct", "low"),
    ("balance_per_unit", "Resident balance per unit", "money", "low"),
    ("concession_per_unit", "Concessions per unit", "money", "low"),
    ("loss_to_lease_per_unit", "Loss to lease per unit", "money", "high"),
    ("notice_rate", "Units on notice", "pct", "high"),
    ("vacancy_rate", "Vacant units", "pct", "high"),
]

OCCUPIED_STATUSES = ("occupied", "notice")
NON_REVENUE_STATUSES = ("model", "down")


RUN = (
    "run_id bigint, started_at timestamp, finished_at timestamp, status string, files_loaded bigint, files_skipped bigint, "
    "files_failed bigint, rows_loaded bigint, tool_version string"
)
FILE = "file_id bigint, run_id bigint, dataset string, file_name string, sha256 string, status string"
ISSUE = (
    "issue_id bigint, run_id bigint, file_id bigint, severity string, rule string, sheet_row int, detail map<string,string>"
)
INSIGHT_RUN = (
    "insight_run_id bigint, snapshot_id int, prompt_sha256 string, model string, status string, note string, kept bigint, dropped bigint, "
    "replaced bigint, started_at timestamp, finished_at timestamp"
)
INSIGHT = (
    "insight_id bigint, snapshot_id int, scope string, property_code string, asset_key string, "
    "category string, priority string, headline string, detail string, "
    "evidence array<struct<metric:string,value:string,comparison:string>>, model string, "
    "prompt_sha256 string, generated_at timestamp"
)
AUDIT = (
    "charge_code string, old_category string, new_category string, old_description string, "
    "new_description string, old_verified boolean, new_verified boolean, note string, "
    "changed_by string, changed_at timestamp"
)
