"""Word lists, patterns and tables that results depend on, stated plainly.

Nothing here is logic. Patterns are in the regular-expression dialect that Java and RE2 share."""

from __future__ import annotations

# Markers of question routes (substrings of the lower-cased question).
MARKERS = {
    "graph": ("board member", "board members", "board of directors", "board composition", "director", "directors", "subsidiary", "subsidiaries", "corporate hierarchy", "ownership structure", "ownership hierarchy"),
    "sql": ("revenue", "net income", "gross margin", "operating income", "ebitda", "cash flow", "eps", "earnings per share", "balance sheet", "debt", "assets", "liabilities", "equity", "ratio", "margin", "profit"),
    "filings": ("10-k", "10-q", "risk factor", "item 1a", "md&a", "management discussion", "material weakness", "footnote", "disclosure", "sec filing"),
    "transcripts": ("earnings call", "management said", "ceo said", "cfo said", "guidance", "investor", "transcript", "press release", "8-k"),
    "patents": ("patent", "ip portfolio", "cpc code", "invention", "patent claim", "intellectual property", "patent filing", "grant date"),
    "litigation": ("lawsuit", "litigation", "court", "settlement", "legal exposure", "case", "plaintiff", "defendant", "judgment"),
}
COMPARISONS = (r"\bcompare\b", r"\bvs\.?\b", r"\bdiscrepanc", r"\bcontradict", r"\bdifference between\b", r"\bwhat management said .+ vs .+filing", r"\bfilings? vs\.? transcript", r"\btranscript vs\.? filing")
#: topic: phrases, summary question, route
TOPICS = {
    "financial_metrics": (("revenue", "net income", "gross margin", "operating income", "cash", "ebitda"), "What are the key financial metrics?", "sql"),
    "risk_factors": (("risk factor", "10-k", "10-q", "item 1a", "md&a", "material weakness"), "What are the key risk disclosures in the SEC filings?", "filings"),
    "management_statements": (("earnings call", "management said", "ceo", "guidance", "transcript"), "What did management say on the earnings call?", "transcripts"),
    "patents": (("patent", "ip portfolio", "cpc", "invention", "claim"), "What is the patent portfolio?", "patents"),
    "litigation": (("lawsuit", "litigation", "court", "settlement", "legal"), "What is the litigation exposure?", "litigation"),
}
CONTRADICTION_QUESTION = "Are there contradictions between management statements and SEC filings for this company?"
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "how", "i", "in", "is", "it", "its", "of", "on", "or", "say", "that", "the", "this", "to", "what", "when", "which", "why")
RECENCY = ("current", "latest", "recent", "today", "now", "live")

# XBRL tags by canonical name.
TAGS = {
    "Revenues": "Revenue",
    "RevenueFromContractWithCustomerExcludingAssessedTax": "Revenue",
    "RevenueFromContractWithCustomerIncludingAssessedTax": "Revenue",
    "NetIncomeLoss": "NetIncome",
    "ProfitLoss": "NetIncome",
    "NetIncomeLossAvailableToCommonStockholdersBasic": "NetIncome",
    "StockholdersEquity": "StockholdersEquity",
    "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest": "StockholdersEquity",
    "OperatingIncomeLoss": "OperatingIncome",
    "Assets": "TotalAssets",
}

# Company aliases by corpus, tickers by name part, legal suffixes.
ALIASES = {
    "transcripts": {"apple": "Apple Inc.", "apple inc": "Apple Inc.", "microsoft": "MICROSOFT CORP", "microsoft corp": "MICROSOFT CORP", "microsoft corporation": "MICROSOFT CORP"},
    "patents": {"apple": "Apple Inc", "apple inc": "Apple Inc"},
    "litigation": {"apple": "Apple Inc", "apple inc": "Apple Inc"},
}
TICKERS = (("apple", "AAPL"), ("aapl", "AAPL"), ("microsoft", "MSFT"), ("msft", "MSFT"), ("nvidia", "NVDA"), ("nvda", "NVDA"), ("meta", "META"), ("facebook", "META"))
LEGAL_SUFFIXES = ("Inc.", "Corp.", "Corporation", "Ltd.", "Limited", "LLC", "PLC", "Group", "Holdings")
ROLES = ("Lead Independent Director", "Independent Director", "Board Chair", "Board Chairman", "Board Chairperson", "Chairman", "Chairperson", "Chair", "Director")

# Patent classes.
CPC_LABELS = {
    "H04": "Telecommunications & Signal Processing", "H01": "Electronic Components", "H03": "Electronic Circuitry", "H05": "Electric Techniques",
    "G06": "Computing & Data Processing", "G02": "Optics", "G01": "Measurement & Testing", "G09": "Displays & Advertising", "G10": "Acoustics", "G11": "Information Storage",
    "A61": "Medical & Health Devices", "A63": "Sports & Entertainment", "B32": "Layered Products & Materials", "C03": "Glass & Ceramics", "C09": "Dyes & Coatings", "F21": "Lighting",
}
CPC_SKIPPED = ("Y",)

# Statements of a Cypher query that write.
WRITE_WORDS = ("CREATE", "MERGE", "DELETE", "DETACH", "SET", "REMOVE", "DROP", "LOAD", "FOREACH", "CALL")

# Headings and fixed lines of filings (patterns ignore case).
MONTHS = "(January|February|March|April|May|June|July|August|September|October|November|December)"
DATE_HEADINGS = (rf"^{MONTHS}\s+\d{{1,2}},\s+\d{{4}}$", rf"^For the quarterly period ended\s+{MONTHS}\s+\d{{1,2}},\s+\d{{4}}$", rf"^For the fiscal year ended\s+{MONTHS}\s+\d{{1,2}},\s+\d{{4}}$", r"^\d{4}$")
TABLE_LABELS = (
    r"^Total(\s*\(\d+\))*$", r"^Total Fair Value$", r"^Fair Value$", r"^Credit Risk Amount$", r"^Notional Amount$", r"^Adjusted Cost$", r"^Unrealized Gains$", r"^Unrealized Losses$",
    r"^Fixed-rate debt(\s*\(\d+\))*$", r"^Services(\s*\(\d+\))*$", r"^Derivative assets(\s*\(\d+\))*:?\s*$", r"^Derivative liabilities(\s*\(\d+\))*:?\s*$", r"^Cash and Cash Equivalents$",
    r"^Current Marketable Securities$", r"^Non-Current Marketable Securities$", r"^Effective Interest Rate$", r"^Weighted-Average Grant-Date Fair Value Per RSU$", r"^Filing Date/?\s*Period End Date$",
    r"^Fiscal Period$", r"^Under the Plans or Programs(\s*\(\d+\))*$", r"^Total Number of Shares Purchased as Part of Publicly Announced Plans or Programs$",
)
BAD_HEADINGS = ("Number of", "Average Price Paid Per Share", "Weighted-Average Grant Date Fair Value Per RSU", "Notional Amount", "Total Number of Shares Purchased")
BAD_TITLES = (
    "Total", "Total Fair Value", "Credit Risk Amount", "Fair Value", "Fixed-rate debt", "Services", "Filing Date/ Period End Date", "Fiscal Period", "Under the Plans or Programs",
    "Weighted-Average Grant-Date Fair Value Per RSU", "Total Number of Shares Purchased as Part of Publicly Announced Plans or Programs",
)
TITLE_NAMES = {"Foreign Exchange Risk": "Foreign Exchange Rate Risk", "Cash, cash equivalents and marketable securities": "Cash, Cash Equivalents and Marketable Securities"}
ITEM_HEADING = r"^Item\s+\d+(?:\.\d+)?[A-Z]?\.?\s*.*$"
PART_HEADING = r"^PART\s+[IVXLC]+\b"
#: the dash class of the note pattern: a hyphen, and the three characters as which a dash is encoded there
NOTE_HEADING = r"^Note\s+\d+\s*[-â€“]"
SECTION_HEADINGS = (r"^PART\s+[IVXLC]+\b.*", ITEM_HEADING, r"^Note\s+\d+\s*[-â€“]\s+.+", r"^[A-Z][A-Za-z0-9,'&/() \-]{3,80}$")
PAGE_FOOTERS = (r"^[A-Za-z0-9 .,&'()/-]+\s*\|\s*.*Form\s+10-[QK]\s*\|\s*\d+$", r"^[A-Za-z0-9 .,&'()/-]+\s*\|\s*(Q[1-4]|FY)\s*\d{4}\s+Form\s+10-[QK]\s*\|\s*\d+$")
IMAGE_NAME = r"\.(jpg|jpeg|png|gif|bmp|webp)$"
CHECKBOXES = ("☒", "☐", "â˜’", "â˜")
BOILERPLATE = (
    r"^UNITED STATES$", r"^SECURITIES AND EXCHANGE COMMISSION$", r"^Washington,\s*D\.C\.\s*\d{5}$", r"^FORM 10-[QK]$", r"^Commission File Number:", r"^Indicate by check mark",
    r"^For the transition period from to \.$", r"^\(Mark One\)$", r"^\(Registrant's telephone number, including area code\)$", r"^\(Exact name of Registrant as specified in its charter\)$",
    r"^TABLE OF CONTENTS$", r"^Part I$", r"^Part II$", r"^FORM 8-K$", r"^CURRENT REPORT$", r"^Pursuant to Section 13 OR 15\(d\) of The Securities Exchange Act of 1934$", r"^Date of Report",
    r"^Commission File Number", r"^State or other jurisdiction of incorporation", r"^I\.R\.S\. Employer Identification No\.", r"^Title of each class", r"^Trading Symbol",
    r"^Name of each exchange on which registered", r"^Check the appropriate box below", r"^Written communications pursuant to Rule 425", r"^Soliciting material pursuant to Rule 14a-12",
    r"^Pre-commencement communications pursuant to Rule 14d-2", r"^Pre-commencement communications pursuant to Rule 13e-4", r"^Yes\s*\S{1,3}\s*No\s*\S{1,3}$",
)
LOW_VALUE_8K_TABLE = (
    "state or other jurisdiction of incorporation", "commission file number", "i.r.s. employer identification no", "written communications pursuant to rule 425", "soliciting material pursuant to rule 14a-12",
    "pre-commencement communications pursuant to rule 14d-2", "pre-commencement communications pursuant to rule 13e-4", "title of each class", "trading symbol", "name of each exchange on which registered",
)
USEFUL_8K_TABLE = ("exhibit", "financial statements", "results of operations", "earnings", "revenue", "net income", "diluted earnings per share", "balance sheet", "cash flow", "99.1", "99.2")
LOW_VALUE_STARTS = ("for the quarterly period ended", "for the fiscal year ended", "securities registered pursuant")
PAGE_STAMP = r"^.+\|\s*\d{4}\s+Form\s+[A-Za-z0-9-]+\s*\|\s*\d+\s*$"
ITEM_TITLE = r"^Item\s+\d+[A-Z]?(?:\.\d+)?[.:]?\s+.+$"

# What is appended to a question for a search of the web.
WEB_SUFFIXES = (
    ({"sql", "filings"}, ("10-k", "10-q", "sec", "filing"), "SEC filing 10-K 10-Q"),
    ({"transcripts"}, ("earnings call", "transcript", "management said"), "earnings call transcript investor relations SEC 8-K"),
    ({"patents"}, ("patent", "ip", "invention"), "patent USPTO Google Patents"),
    ({"litigation"}, ("lawsuit", "litigation", "court", "case"), "litigation court case CourtListener"),
)
WEB_DEFAULT = "M&A due diligence official source"

# Metrics of a due-diligence sweep with their question templates (figures, statements).
SWEEP = (
    ("Total Revenue", "What is {company}'s total net sales or revenue for {period}?", "What did {company} report about total revenue or net sales in {period}?"),
    ("Net Income", "What is {company}'s net income for {period}?", "What did {company} say about net income or profitability in {period}?"),
    ("Gross Margin", "What is {company}'s gross margin or gross profit for {period}?", "What did {company} say about gross margin in {period}?"),
    ("Operating Income", "What is {company}'s operating income for {period}?", "What did {company} say about operating performance in {period}?"),
    ("R&D Spending", "What is {company}'s research and development expense for {period}?", "What did {company} say about research and development investment in {period}?"),
    ("Cash and Equivalents", "What is {company}'s cash and cash equivalents for {period}?", "What did {company} say about cash position or liquidity in {period}?"),
)
SCORE_WEIGHTS = {"faithfulness": 0.35, "completeness": 0.30, "numerical_accuracy": 0.25, "citation_accuracy": 0.10}
NUMBER = r"(?i)\$?\s*(\d[\d,]*\.?\d*)\s*(?:billion|trillion|million|B|T|M)?"

# How answers are to look. Beginnings of questions for yes or no; phrases that ask for several things, of an
# answer and of a merged answer; most words of an answer, of one without documents, and of a merged one; bullets at most;
# characters of a failed context that a rewriter sees.
YES_NO = ("is ", "are ", "has ", "have ", "can ", "does ", "do ", "did ", "was ", "were ")
SEVERAL = ("what are", "list", "what patents", "what lawsuits", "what risk factors", "what metrics", "what did management", "enumerate", "summarize all")
SEVERAL_MERGED = ("what does", "what do", "what topics", "what courses", "what is the syllabus", "cover", "covers", "list")
MOST_WORDS = {"answer": 140, "direct": 90, "merged": 160}
MOST_BULLETS = 4
PREVIEW = 250
