"""Lab vocabulary: labels, priorities and display orders.

Fixed values: results depend on these exact texts and orders. Every operator takes them as
parameters, so another lab passes its own.
"""

OTHER = "Other"
EXPANDERS = "E² Expanders"
NO_LOCATION = "No Location"

# Category priority of a case that owns several products; '%' marks a LIKE pattern.
CATEGORY_PRIORITY = [
    "Hybrid",
    "E%Expander%",
    "Lab to Lab",
    "Marpe",
    "Metal",
    "Clear",
    "Wire Bending",
    "Airway",
]
WORKLOAD_PRIORITY = [c for c in CATEGORY_PRIORITY if c != "Airway"]

# Canonical labels for category texts.
CATEGORY_ALIASES = {
    "Airway": "MARPE",
    "Marpe": "MARPE",
    "Lab to lab": "Lab to Lab",
}
WORKLOAD_ALIASES = {
    **CATEGORY_ALIASES,
    "Accessories": "Other",
}

WORKLOAD_CATEGORY_ORDER = [
    "Hybrid",
    "E² Expanders",
    "Lab to Lab",
    "MARPE",
    "Metal",
    "Clear",
    "Wire Bending",
    "Other",
]
CHECKIN_CATEGORY_ORDER = [
    "Metal",
    "MARPE",
    "Clear",
    "E² Expanders",
    "Hybrid",
    "Wire Bending",
    "Lab to Lab",
    "Other",
]

# Planning stages: a MARPE case there is not yet on the floor.
PLANNING_LOCATIONS = [
    "New Cases",
    "New Cases How to Proceed",
    "New Cases Waiting For Scans",
    "Email Plan Case",
    "Email Follow Up",
    "Zoom Set Up",
    "Zoom Consult",
    "Zoom Export Needed",
    "Zoom Waiting Approval",
    "Airway Zoom Plan",
    "Airway Email Approval",
    "Airway Planning",
    "Airway Email Plan",
    "Airway Zoom Approval",
]
STAGE_GROUPS = {
    "NEW CASES": ["New Cases", "New Cases How to Proceed", "New Cases Waiting For Scans"],
    "EMAIL": ["Email Plan Case", "Email Follow Up"],
    "ZOOM": ["Zoom Set Up", "Zoom Consult", "Zoom Export Needed", "Zoom Waiting Approval"],
}

LOCATION_ALIASES = {
    "Marpe Finish": "Marpe",
    "Marpe Assembly": "Marpe",
    "Marpe Weld": "Marpe",
    "Marpe PreWeld": "Marpe",
    "Marpe Dlyte": "Marpe",
    "Wire E&P": "Wire Finishing/Polishing",
    "Shipping Hold Tray": "Shipping Hold Table",
    "Intake Hold Tray": "Intake Hold Table",
}
LOCATION_ORDER = [
    "Design Cart",
    "3D Design",
    "3D Manufacturing",
    "Oven",
    "Metal Shelf",
    "Metal Finish",
    "Tumbler",
    "Banding",
    "Metal Bending",
    "Welding",
    "Metal Polishing",
    "Marpe",
    "Wire Shelf",
    "Wire Bending",
    "Acrylic",
    "Wire Finishing/Polishing",
    "Essix Shelf",
    "QC",
    "Production Floor Desk",
    "Shipping Hold Table",
    "Clinical Director",
    "Intake Hold Table",
]
DESIGN_LOCATIONS = ["Design Cart", "3D Design"]
MANUFACTURING_LOCATIONS = ["3D Manufacturing", "Oven", "Tumbler"]
FLOOR_LOCATIONS = [
    "Metal Shelf",
    "Metal Finish",
    "Metal Polishing",
    "Banding",
    "Metal Bending",
    "Welding",
    "Marpe",
    "Wire Bending",
    "Acrylic",
    "Wire Finishing/Polishing",
    "Essix Shelf",
    "QC",
    "Production Floor Desk",
]

HOLD_MARKERS = ["AFU", "ZFU", "EFU"]
HOLD_STATUSES = [
    "Production, Waiting on Scan",
    "Airway, How to Proceed",
    "Email Plan,Waiting on Approval",
    "Zoom Plan, Waiting on Approval",
]

AIRWAY_TASKS = ["3dplan", "3dfin-exp", "3drevise"]
DESIGN_TASKS = ["3dd", "3dcf"]

# (name, first hour, last hour): task windows of a day, upper bound exclusive.
DESIGN_WINDOWS = [("noon", 3, 12), ("pm3", 3, 15), ("pm11", 15, 24), ("allday", 3, 24)]
CHECKIN_WINDOWS = [("noon", 0, 12), ("all", 0, 18)]
# Snapshot windows include their upper bound.
SNAPSHOT_WINDOWS = [("noon", 3, 12), ("3pm", 3, 15)]

HIDDEN_TEAM = "z_Not On Report"
BROKEN_TEAM_CODES = ["0", "O"]

# Repository name of a case document -> folder on the share.
DOCUMENT_FOLDERS = {
    "CaseDocuments": "CaseDocuments",
    "Digital Impression": "DigitalImpressions",
    "Design": "Designs",
    "Model Scan": "ModelScans",
}

PACE_TIERS = [(25, "red"), (50, "orange"), (75, "yellow")]
GOAL_BANDS = [(110, "dark green"), (100, "green"), (90, "amber")]
LOAD_TIERS = [(15, "low"), (50, "medium")]

CUSTOMER_LABELS = {
    "customer_id": "ID",
    "practice_name": "Practice Name",
    "full_name": "Contact",
    "sales_person": "Account Manager",
    "dental_group": "Dental Group",
    "type": "Type",
    "specialty": "Specialty",
    "city": "City",
    "state": "State",
    "price_catalog": "Price List",
    "mtd_sales": "MTD Sales",
    "lm_sales": "Last Month",
    "ytd_sales": "YTD Sales",
    "ly_sales": "Last Year",
    "ltd_sales": "Lifetime",
    "date_of_first_case": "First Case",
    "date_of_last_case": "Last Case",
    "active": "Active",
    "prospect": "Prospect",
}
CUSTOMER_FILTERS = [
    "sales_person",
    "dental_group",
    "type",
    "specialty",
    "state",
    "city",
    "price_catalog",
]
