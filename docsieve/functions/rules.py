"""Word lists of the matching and scoring rules. All tuples here are fixed values that decide results."""

# Sectors in order of precedence with their keywords; a repeated keyword counts twice, and upper-case
# keywords never occur in lower-case text.
SECTORS = {
    "Financial Services": ("bank", "financial", "insurance", "fund", "capital", "asset management", "investment", "securities", "credit", "finance", "banking"),
    "Energy": ("energy", "oil", "gas", "petroleum", "coal", "power", "electricity", "solar", "wind", "renewable", "nuclear", "utility"),
    "Materials": ("materials", "mining", "metals", "steel", "aluminum", "copper", "chemicals", "cement", "paper", "forestry", "mining"),
    "Utilities": ("utilities", "water", "electric", "gas distribution", "utility"),
    "Telecommunications": ("telecom", "telecommunications", "mobile", "broadband", "wireless", "communications", "tower", "network"),
    "Real Estate": ("real estate", "property", "reit", "land", "development", "construction"),
    "Transportation": ("transport", "logistics", "shipping", "airline", "railway", "port", "freight", "cargo", "delivery"),
    "Infrastructure": ("infrastructure", "construction", "engineering", "roads", "highways", "bridges", "ports", "airports"),
    "Consumer Discretionary": ("consumer", "retail", "automobile", "auto", "automotive", "hotel", "restaurant", "entertainment", "media", "apparel", "luxury"),
    "Conglomerate": ("conglomerate", "holding", "group", "diversified", "holdings"),
    "Consumer Staples": ("staples", "food", "beverage", "grocery", "fmcg", "consumer goods", "packaged goods", "tobacco", "household"),
    "Industrials": ("industrial", "manufacturing", "machinery", "equipment", "defense", "aerospace", "electrical", "automation"),
    "Agriculture": ("agriculture", "farming", "agro", "crop", "fertilizer", "seeds", "dairy", "livestock", "plantation"),
    "Healthcare": ("healthcare", "pharmaceutical", "pharma", "biotech", "medical", "hospital", "diagnostics", "drugs", "medicine", "health"),
    "Technology/Media": ("technology", "software", "IT", "internet", "tech", "digital", "cloud", "semiconductor", "electronics", "media", "telecom"),
    "Services": ("services", "consulting", "outsourcing", "BPO", "staffing", "education", "training", "hospitality"),
}

# Document types in order of precedence with the phrases that name them in a request.
REQUEST_TYPES = {
    "annual_report": ("annual report", "annual-report", "yearly report", "10-k", "10k", "annual filing", "annual results"),
    "quarterly_report": ("quarterly report", "quarterly-report", "quarter report", "10-q", "10q", "quarterly results", "quarterly filing", "q1", "q2", "q3", "q4"),
    "investor_presentation": ("investor presentation", "investor deck", "earnings presentation", "investor ppt", "corporate presentation", "earnings call presentation", "investor day", "analyst presentation"),
}

# Hosts and words that the candidate score looks for.
TRUSTED_HOSTS = (
    "sec.gov", "bseindia.com", "nseindia.com", "archives.nseindia.com", "nsearchives.nseindia.com", "kap.org.tr", "dfm.ae", "feeds.dfm.ae", "adx.ae", "apigateway.adx.ae",
    "saudiexchange.sa", "bursamalaysia.com", "sgx.com", "set.or.th", "jse.co.za", "ngxgroup.com", "stockex.co.tt", "jamstockex.com",
)
PRESS_RELEASE = (
    "press_release", "press-release", "pressrelease", "media-release", "media_release", "mediarelease", "news-release", "news_release", "newsrelease",
    "press/release", "media/release", "news/release", "/media/", "/news/", "/announcement", "credit_rating", "credit-rating", "creditrating",
)
RATING_HOSTS = ("careratings", "crisil", "icra.in", "icra.com", "infomerics", "acuite", "brickworkratings", "india-ratings", "moodys.com", "spglobal.com", "fitchratings")
ANNUAL = (
    "annual", "annual-report", "annual_report", "ar20", "annualreport", "integrated-report", "integrated_report", "annual-review", "annual_review", "10-k", "10k", "20-f", "20f",
)
QUARTERLY = ("quarterly", "quarter", "q1", "q2", "q3", "q4", "10-q", "10q")
REJECT_URL = (
    "quarter", "q1", "q2", "q3", "q4", "q5", "10-q", "10q", "interim", "half-year", "halfyear", "_h1_", "_h2_", "-h1-", "-h2-", "sustainability", "sustainable", "esg",
    "environmental", "environment", "climate", "csr", "corporate-social", "proxy", "prospectus", "press-release", "transcript", "factsheet", "annual-return", "annual_return",
    "annualreturn", "fitch", "moodys", "moody-", "credit-opinion", "rating-report", "ratings-report", "rating_report", "modern-slavery", "gender-pay", "pillar3", "pillar-3",
    "whistleblowing", "anticorruption", "anti-corruption", "buyback", "buy-back", "rights-issue", "rights_issue",
)
REJECT_FILE = (
    "notice", "agm", "circular", "supplement", "offering", "memorandum", "earnings", "results", "governance", "remuneration", "directors report", "directors-report", "audit report",
    "audit-report", "audit_report", "financial-statement", "financial_statement", "investor presentation", "investor-presentation", "capital markets day", "investor-day",
    "investor_day", "equity-story", "equity_story", "consent-form", "data-protection", "privacy-policy", "compliance-report", "ethics-report", "code-ethics", "risk-register",
    "risk-framework", "gender pay gap", "tax-strategy", "tax-transparency", "supplier-code", "customer-charter", "nomgov", "nom-gov", "terms-of-reference", "board-charter",
    "governance-framework", "scrip-dividend", "dividend-notice", "notification", "share-repurchase", "prezentare", "prezentari", "preliminare", "raport-asf", "raport-consiliu",
    "raport-remunerare", "raport-audit", "situatii-financiare", "rezultate-financiare", "mining-cvp", "customer-value", "value-proposition", "anti-bribery", "code-of-conduct",
    "bribery-policy", "conflict-of-interest", "gender-pay-gap", "rb-report", "briefing document",
)
REJECT_PATH = (
    "/agm/", "/aga/", "/agm-20", "/aga-20", "/adunare/", "/adunare-generala/", "/shareholder-meeting/", "/general-meeting/", "/extraordinary/", "/egm/", "/proxy/", "/circular/",
    "/regulatory-filing/", "/regulatory/", "/raport-asf/", "/asf-filing/", "/rezultate-financiare/", "/rezultate/", "/prezentari/", "/prezentari-roadshows", "/preliminare/",
)
ENGLISH_URL = ("english", "_en_", "-en-", "_en.", "-en.", "eng_", "_eng", "english-version")
FOREIGN_URL = (
    "arabic", "_ar_", "_ar.", "-ar-", "عربي", "uzbek", "_uz_", "russian", "_ru_", "_ru.", "turkish", "_tr_", "_tr.", "chinese", "_cn_", "french", "_fr_", "german", "_de_",
)
# Fixed values: (words of a company's name, words of paths that belong to its subsidiaries).
SUBSIDIARY_PATHS = (
    (("adani ports", "apsez"), ("/acc/", "/adani-cement/", "/adani-green/", "/adani-power/")),
    (("eskom",), ("grootvlei", "medupi", "kusile", "koeberg", "matimba", "lethabo", "tutuka", "hendrina", "arnot", "camden")),
)

# Words that the crawler's link rules look for.
LINK_TYPES = {
    "annual_report": ("annual", "yearly", "10-k", "10k"),
    "quarterly_report": ("quarterly", "quarter", "10-q", "10q", "q1", "q2", "q3", "q4"),
    "investor_presentation": ("presentation", "investor-day", "analyst-day", "deck"),
}
FINANCE_PAGE = ("financial", "annual", "report", "investor", "ir/", "investors", "shareholder", "filings", "disclosures", "quarterly")
ANNUAL_HREF = ("annual-report", "annual_report", "ar20", "annualreport", "/ar/", "yearly-report", "annual-results", "integrated-report", "integrated_report", "annual-review", "annual_review")
ANNUAL_TEXT = (
    "annual report", "annual review", "integrated report", "integrated annual", "yearly report", "full year results", "annual results", "年報", "rapport annuel", "jahresbericht",
    "informe anual", "relatório anual", "годовой отчет", "yıllık rapor", "年度报告", "تقرير سنوي", "سالانه",
)
ENGLISH_LINK = ("english", "_en", "-en.", "_en_", "en.pdf", "eng", "english-version")
FOREIGN_LINK = ("arabic", "_ar.", "_ar_", "عربي", "uzbek", "_uz", "russian", "_ru.", "turkish", "_tr.", "chinese", "_cn.", "french", "_fr.", "german", "_de.")
LINK_REJECT = (
    "quarter", "q1", "q2", "q3", "q4", "q5", "interim", "half-year", "halfyear", "h1", "h2", "financial-statement", "financial_statement", "annual-return", "annual_return",
    "annualreturn", "company-return", "statutory-return", "filing-return", "roc-filing", "notice-of-agm", "notice_of_agm", "agm-notice", "agm_notice", "sustainability",
    "sustainable", "esg", "environmental", "environment", "climate", "csr", "corporate-social", "governance", "remuneration", "proxy", "notice", "agm", "circular", "prospectus",
    "supplement", "offering", "memorandum", "earnings", "results", "press-release", "transcript", "presentation", "factsheet", "pillar3", "pillar-3", "audit-report",
    "audit report", "audit_report", "modern slavery", "modern-slavery", "slavery statement", "slavery-statement", "gender pay", "gender-pay", "tax strategy", "tax-strategy",
    "pillar 3", "directors report", "directors-report", "half year", "capital markets day", "rb-report", "rb_report", "briefing document", "investor-day", "investor_day",
    "investor day", "rights-issue", "rights_issue", "rights issue", "offer document", "offer-document", "scrip-dividend", "scrip_dividend", "credit-rating", "credit_rating",
    "credit rating", "mdys", "moodys-", "fitch-", "moody", "buyback", "buy-back", "buy_back", "buy back", "share-repurchase", "share_repurchase", "notification",
    "dividend-notice", "equity-story", "equity_story", "equity story", "consent-form", "consent_form", "consent form", "data-protection", "data_protection", "data protection",
    "privacy-policy", "privacy_policy", "where-we-operate", "raport-asf", "raport_asf", "raport asf", "raport-consiliu", "raport_consiliu", "raport-remunerare",
    "raport_remunerare", "raport-audit", "raport_audit", "situatii-financiare", "situatii_financiare", "prezentare", "prezentari", "preliminar", "rezultate-financiare",
    "rezultate_financiare", "mining-cvp", "mining_cvp", "-cvp-", "_cvp_", "customer-value", "value-proposition", "anti-bribery", "anti_bribery", "code-of-conduct",
    "code_of_conduct", "bribery-policy", "bribery_policy", "whistleblowing", "whistle-blowing", "conflict-of-interest", "conflict_of_interest", "tax-transparency",
    "tax_transparency", "supplier-code", "supplier_code", "customer-charter", "customer_charter", "nomgov", "nom-gov", "nomination-governance", "terms-of-reference",
    "committee-charter", "board-charter", "risk-register", "reestr-riskov", "risk-appetite", "risk-framework", "anticorrupcion", "anti-corruption", "anticorruption",
    "compliance-report", "compliance-framework", "ethics-report", "code-ethics", "bribery-act", "antibribery", "grootvlei", "medupi", "kusile", "koeberg", "matimba", "lethabo",
    "tutuka", "hendrina",
)
LINK_ACCEPT = (
    "annual", "yearly", "ar2", "integrated report", "integrated-report", "annual review", "rapport annuel", "годовой", "yıllık", "relatório anual", "jahresbericht",
    "informe anual", "年度报告", "سالانه", "تقرير سنوي",
)
QUARTERLY_HIT = (
    "_q1", "_q2", "_q3", "_q4", "/q1-", "/q2-", "/q3-", "/q4-", "q1_", "q2_", "q3_", "q4_", " q1 ", " q2 ", " q3 ", " q4 ", "-q1-", "-q2-", "-q3-", "-q4-", "_fs_q", "quarterly",
    "interim", "half-year", "halfyear", "q1-", "q2-", "q3-", "q4-", "_pr_", "_pr.", "/press", "press-release", "pressrelease", "invpres", "invcert", "nseinvpres", "/downloads/ipo/",
)
ANNUAL_HIT = ("annual", "_ar.", "annualreport", "annual-report", "yearly", "/ar/", "ar_20", "ar20")

# Words of names that do not identify a company.
LEGAL_SUFFIXES = (
    "plc", "jsc", "llc", "ltd", "inc", "corp", "corporation", "as", "sa", "nv", "bv", "ag", "gmbh", "oy", "ab", "asa", "se", "spa", "srl", "pjsc", "oao", "pao", "ojsc", "bhd", "tbk",
    "limited", "co",
)
COMMON_WORDS = (
    "united", "bank", "group", "holding", "holdings", "company", "companies", "international", "national", "global", "general", "africa", "american", "americas", "europe",
    "european", "asia", "asian", "pacific", "middle", "east", "north", "south", "west", "china", "india", "kingdom", "states", "federal", "for", "and", "the", "of",
)
REGION_WORDS = {
    "uae": ("pjsc", "p.j.s.c", "dubai", "abu dhabi", "emaar", "adnoc", "emirates nbd", "dib", "etisalat", "du telecom"),
    "india": (" limited", " ltd", " industries", " enterprises", " pharmaceuticals", "infosys", "wipro", "reliance", "tata"),
    "turkey": ("a.ş",),
}
# Publishers that are not sources of company documents.
THIRD_PARTY_HOSTS = ("planet-tracker.org", "influencemap.org", "carbontracker.org", "shareaction.org", "sustainalytics.com")
THIRD_PARTY_PATHS = (("msci.com", "/esg"), ("spglobal.com", "/esg"))
