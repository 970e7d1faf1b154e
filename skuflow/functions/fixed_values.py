"""Constants, word lists and texts that results must agree with."""

# Fixed values. Service level and month length of the reorder formula.
SERVICE_Z = 1.64
DAYS_PER_MONTH = 30.0
DEFAULT_LEAD_TIME_DAYS = 30.0

# Fixed values. Months of the high season and weights of the ABC classes.
HIGH_SEASON_MONTHS = (10, 11, 12, 1)
ABC_WEIGHTS = {"A": 3, "B": 2, "C": 1}
ABC_OTHER = 1

# Fixed values. Columns of the feature matrix and of the anomaly features.
FEATURE_COLUMNS = (
    "lag_1", "lag_3", "lag_6",
    "roll_mean_3", "roll_std_3", "roll_mean_6",
    "yoy_growth", "month", "quarter",
    "abc_enc", "is_high_season",
)
ANOMALY_COLUMNS = ("net_units", "lag_1", "roll_mean_3", "roll_std_3", "is_high_season")

# Fixed values. Severity limits: reorder gap in units, anomaly score.
REORDER_HIGH_GAP = -50
REORDER_MEDIUM_GAP = 0
ANOMALY_HIGH_SCORE = -0.2
ANOMALY_MEDIUM_SCORE = -0.1
SEVERITY_ORDER = ("high", "medium", "low")
ZSCORE_LIMIT = 2.5
ZSCORE_EPSILON = 1e-8
ALERT_ANOMALY_CAP = 10
SCAN_ANOMALY_CAP = 8
SKU_ANOMALY_CAP = 5
CONTAMINATION_LEVELS = (0.02, 0.05, 0.08, 0.10, 0.15)

# Fixed values. Tax rate of purchase orders.
GST_RATE = 0.18

# Fixed values. Bounds of requests.
QUESTION_LENGTH = (3, 500)
HORIZON_ONE_SKU = (1, 12)
HORIZON_ALL_SKUS = (1, 6)

# Fixed values. Blanks that are trimmed and that words are split at: those of Unicode, as Python's strip and split know them.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed values. Chunk size, overlap and separators; shingle size; duplicate limit in percent.
CHUNK_CHARS = 1600
CHUNK_OVERLAP = 200
CHUNK_SEPARATORS = ("\n\n", "\n", ".", " ", "")
SHINGLE_WORDS = 4
NEAR_DUPLICATE_PERCENT = 85
MINHASH_PERMUTATIONS = 128

# Fixed values. Texts shown when nothing is found, and the separator of context blocks.
NO_DOCUMENTS = "No relevant documents found."
CONTEXT_SEPARATOR = "\n\n---\n\n"
SUPPLIERS_SHOWN = 3
SUPPLIERS_LISTED = 5

# Fixed values. Pattern of SKU codes.
SKU_PATTERN = (
    r"\b(SC|TBW|PBW|PBP|TBP|PNT|CS|GTP|HNG|CRO|TNB|RSH|AAT|CHM|MGC"
    r"|RM-WR|RM-CH|RM-PL|RM-FT|RM-CB)-\d+\b"
)

# Fixed values. Keywords of the intents; the order of the intents breaks ties.
INTENT_KEYWORDS = {
    "demand": [
        "forecast", "predict", "demand", "how many units", "next month",
        "sales", "projection", "expected", "trend", "consumption",
    ],
    "reorder": [
        "reorder", "reorder point", "rop", "replenish", "stock", "inventory",
        "low stock", "order more", "safety stock", "days of stock",
        "out of stock", "stockout", "when to order", "how much to order",
    ],
    "supplier": [
        "supplier", "vendor", "who supplies", "lead time", "payment terms",
        "catalog", "price", "rate", "moq", "minimum order", "credit",
        "best supplier", "which supplier", "source",
    ],
    "anomaly": [
        "anomaly", "unusual", "spike", "outlier", "alert", "abnormal",
        "strange", "unexpected", "flag", "detect", "problem", "issue",
    ],
}

# Fixed values. Texts of alerts, forecasts, stock, suppliers and answers; values stand in for the names in braces.
REORDER_MESSAGE = "Stock {available} ≤ ROP {reorder_point}. Place order immediately ({status})."
ANOMALY_MESSAGE = "Unusual demand in {month}: {units} units vs 3M avg {average}."
FORECAST_HEAD = "Demand forecast for {sku} (next {horizon} months):\n{lines}"
FORECAST_LINE = "  Month +{month}: {forecast} units  (90% CI: {lower} – {upper})"
STOCK_TEXT = (
    "Inventory — {sku} ({item}):\n"
    "  On-Hand: {on_hand}  |  WIP: {wip}  |  In-Transit: {in_transit}\n"
    "  Total Available: {available}  |  Reorder Point: {reorder_point}\n"
    "  Days of Stock: {days}  |  Status: {status}\n"
    "  Gap vs ROP: {gap} units  — {verdict}"
)
STOCK_VERDICTS = ("⚠️ REORDER NEEDED", "✓ OK")
ROP_TEXT = (
    "ROP Analysis — {sku}:\n"
    "  Avg daily demand: {daily} units\n"
    "  Lead time: {lead_time} days\n"
    "  Safety stock (95% SL): {safety_stock} units\n"
    "  Computed ROP: {rop} units\n"
    "  Current available: {available} units\n"
    "  {verdict}"
)
ROP_VERDICTS = ("⚠️ REORDER NOW", "✓ Stock OK")
SUPPLIER_HEAD = "Supplier: {name} ({id})\n  City: {city}, {state}"
RECOMMENDATION = "🏆 Recommended supplier for {sku}: {name} (Lead time: {lead_time} days, On-time rate: {on_time}%)"
SCAN_LINE = "  • {sku} ({item}): Available={available}  ROP={reorder_point}  Gap={gap}"
SCAN_HEADLINE = "⚠️  {count} SKU(s) at or below reorder point:"
SCAN_NOTHING = "✓ All SKUs are above their reorder points. No immediate action needed."
ANOMALY_SCAN_LINE = "  • {sku} ({item}) | Period: {month} | Units: {units} | 3M-Avg: {average} | Score: {score}"
ANOMALY_SCAN = "🚨 {count} anomalous data point(s) detected:\n\n{lines}"
ANOMALY_SCAN_NOTHING = "✓ No anomalies detected across all SKUs."
SKU_ANOMALY_LINE = "  {month}: {units} units sold (3-month avg: {average}), score: {score}"
SKU_ANOMALIES = "Anomalies detected for {sku}:\n{lines}"
NO_SKU_ANOMALIES = "No anomalies detected for SKU {sku}."
NO_FORECAST = "No forecast data available for SKU {sku}."
NO_STOCK = "SKU {sku} not found in inventory."
NO_HISTORY = "No demand history for {sku}."
NO_SUPPLIER = "No supplier mapping found for the specified SKU."
HISTORICAL_CONTEXT = "📄 Historical Context:\n{context}"
DEMAND_ANSWER = "📊 Demand Forecast — {sku}\n\n{body}\n\n{context}"
ANOMALY_ANSWER = "🔍 Anomaly Analysis\n\n{body}{context}"
CONTEXT_BLOCK = "[Source {place}: {source} — Page {page}]\n{text}"

# Fixed values. Search texts of the handlers.
DEMAND_SEARCH = "demand history seasonal sales {sku}"
REORDER_SEARCH = "purchase order {sku} reorder"
REORDER_SEARCH_ALL = "low stock reorder"
SUPPLIER_SEARCH = "supplier catalog pricing terms {sku} {question}"
ANOMALY_SEARCH = "unusual demand spike stockout {sku} {question}"
