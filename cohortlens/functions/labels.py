"""Fixed output values.

FIXED VALUES: these strings and constants must equal the analytics
suite's own output exactly, so they are kept verbatim, in the order the
reports evaluate them.
"""

# FIXED VALUES — platforms reported as separate columns
PLATFORMS = ["web", "android", "ios"]

# FIXED VALUES — account anomaly risk levels
RISK_EXTREME = "Extreme Risk"
RISK_HIGH = "High Risk"
RISK_MEDIUM = "Medium Risk"
RISK_LOW = "Low Risk"

# FIXED VALUES — longitude bands (lower, upper, label); BETWEEN is inclusive
# and the first matching band wins on shared edges
TIMEZONE_BANDS = [
    (-180, -120, "UTC-8 to UTC-11"),
    (-120, -60, "UTC-4 to UTC-8"),
    (-60, 0, "UTC-0 to UTC-4"),
    (0, 60, "UTC+0 to UTC+4"),
    (60, 120, "UTC+4 to UTC+8"),
    (120, 180, "UTC+8 to UTC+12"),
]
TIMEZONE_UNKNOWN = "Unknown"

# FIXED VALUES — market classification
MARKET_HIGH_VALUE = "High Value"
MARKET_MEDIUM_VALUE = "Medium Value"
MARKET_HIGH_RISK = "High Risk"
MARKET_STANDARD = "Standard"

# FIXED VALUES — session impact user categories (heaviest first)
SESSION_USER_CATEGORIES = [
    "Heavy Users (100+ events)",
    "Moderate Users (50-99 events)",
    "Regular Users (20-49 events)",
    "Light Users (10-19 events)",
]

# FIXED VALUES — gaming assessment
GAMING_LIKELY = "Likely Gaming"
GAMING_POSSIBLE = "Possible Gaming"
GAMING_SUSPICIOUS = "Suspicious Pattern"
GAMING_NORMAL = "Normal Usage"

# FIXED VALUES — RFM customer segments
SEG_WALK_IN = "Walk-in Guests"
SEG_POTENTIAL = "Potential Customers"
SEG_REGULAR = "Regular Customers"
SEG_VIP = "VIP"
SEG_AT_RISK = "At-risk Customer"
SEG_OTHER = "Other"

# FIXED VALUES — engagement segments (most events first)
ENGAGEMENT_SEGMENTS = [
    "Power Users (100+ events)",
    "High Users (50-99 events)",
    "Medium Users (20-49 events)",
    "Low Users (5-19 events)",
    "Minimal Users (1-4 events)",
]

# FIXED VALUES — churn statuses, in report order
CHURN_STATUSES = ["Active", "At Risk", "Dormant", "Churned"]

# FIXED VALUES — lifetime-value segments, in report order
CLV_SEGMENTS = [
    "High Value (100+)",
    "Medium Value (50-99)",
    "Low Value (10-49)",
    "Minimal Value (0-9)",
    "No Revenue",
]
