"""Word lists, tables, patterns and weights the rules depend on.

Nothing here is computed; results are only right with exactly these values.
"""

from __future__ import annotations

# --- Fixed values: URLs -------------------------------------------------------------------

TRACKING_KEYS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "utm_id", "utm_reader", "utm_place", "utm_brand",
    "ref", "referer", "referrer", "source",
    "fbclid", "gclid", "msclkid", "_openstat",
    "ga_source", "ga_medium", "ga_campaign",
    "mc_eid", "mkt_tok", "spjobid", "spmailingid", "spreportid",
    "si", "s", "fb_action_ids", "fb_action_types",
    "action_object_map", "action_type_map", "action_ref_map",
    "recruitedby", "from", "via",
]

# (path word, page type, priority), first hit wins
PAGE_PATTERNS = [
    ("/contact", "contact", 10), ("/contacts", "contact", 10), ("/get-in-touch", "contact", 10), ("/reach-us", "contact", 10),
    ("/about", "about", 9), ("/about-us", "about", 9), ("/who-we-are", "about", 9),
    ("/company", "about", 8), ("/our-story", "about", 8), ("/profile", "about", 7),
    ("/team", "team", 7), ("/leadership", "team", 7), ("/management", "team", 7), ("/our-people", "team", 7),
    ("/product", "products", 6), ("/products", "products", 6), ("/service", "services", 6),
    ("/solutions", "products", 5), ("/catalog", "products", 5),
    ("/career", "careers", 3), ("/join", "careers", 3),
    ("/news", "news", 2), ("/blog", "blog", 2), ("/press", "news", 2), ("/media", "news", 2), ("/article", "news", 1),
    ("/privacy", "legal", 1), ("/terms", "legal", 1), ("/legal", "legal", 1), ("/cookie", "legal", 1), ("/gdpr", "legal", 1),
    ("/faq", "faq", 3), ("/help", "faq", 3), ("/support", "faq", 3),
]

# page type -> rank when pages are chosen for a site
PAGE_TYPE_ORDER = [
    ("homepage", 0), ("contact", 1), ("about", 2), ("team", 3), ("products", 4), ("services", 5),
    ("faq", 6), ("careers", 7), ("news", 8), ("blog", 9), ("legal", 10), ("other", 11),
]

# second rule set: page type -> words, first type with a hit wins
PAGE_WORDS = [
    ("contact", ["contact", "reach", "get-in-touch", "support", "location", "address", "map"]),
    ("about", ["about", "who-we-are", "company-profile", "our-story", "vision", "mission"]),
    ("products", ["product", "service", "solution", "catalog", "portfolio", "what-we-do", "capability", "gallery"]),
    ("industries", ["industr", "sector", "market", "application"]),
    ("clients", ["client", "customer", "partner", "reference", "case-stud"]),
    ("legal", ["legal", "privacy", "term", "policy", "compliance", "cr-certificate"]),
    ("news", ["news", "blog", "article", "press", "event", "media"]),
]

PAGE_WEIGHTS = [
    ("homepage", 100), ("contact", 95), ("about", 90), ("products", 85), ("industries", 80),
    ("legal", 70), ("clients", 60), ("other", 10), ("news", 5),
]

SOCIAL_PATTERNS = [
    ("linkedin", r"linkedin\.com/company/[^\"'\s]+"),
    ("twitter", r"twitter\.com/[^\"'\s]+"),
    ("facebook", r"facebook\.com/[^\"'\s]+"),
    ("instagram", r"instagram\.com/[^\"'\s]+"),
    ("youtube", r"youtube\.com/[^\"'\s]+"),
    ("tiktok", r"tiktok\.com/@[^\"'\s]+"),
]

# word in the domain -> seed tag
SEED_TAG_WORDS = [
    ("chamber", "chamber"), ("gov.sa", "government"), ("mcci", "chamber"),
    ("cybo", "b2b-portal"), ("bizmideast", "b2b-portal"),
    ("ksa.directory", "saudi-directory"), ("saudidir", "saudi-directory"),
    ("saudiindustryguide", "industry-guide"),
]

# path roots that take a language prefix
PREFIXABLE_ROOTS = [
    "/search", "/category/", "/company/", "/region/", "/tags/", "/submit", "/privacy",
    "/admin", "/research", "/categories", "/regions",
]

# --- Fixed values: names, cities, junk ------------------------------------------------------

LEGAL_SUFFIXES = [
    "co.", "corp.", "ltd.", "llc", "inc.", "gmbh", "ag",
    "limited", "corporation", "company", "establishment",
    "للمساهمة", "المحدودة", "ذات المسؤولية المحدودة",
]

LEGAL_WORDS = ["inc", "llc", "ltd", "corp", "co", "gmbh", "ag", "limited", "corporation", "company"]

CITY_SPELLINGS = [
    ("riyadh", "Riyadh"), ("الرياض", "Riyadh"),
    ("jeddah", "Jeddah"), ("جدة", "Jeddah"),
    ("mecca", "Mecca"), ("مكة", "Mecca"),
    ("medina", "Medina"), ("المدينة", "Medina"),
    ("dammam", "Dammam"), ("الدمام", "Dammam"),
    ("khobar", "Al Khobar"), ("الخبر", "Al Khobar"),
    ("dhahran", "Dhahran"), ("الظهران", "Dhahran"),
    ("tabuk", "Tabuk"), ("تبوك", "Tabuk"),
    ("abha", "Abha"), ("أبها", "Abha"),
    ("hail", "Hail"), ("حائل", "Hail"),
    ("buraydah", "Buraydah"), ("بريدة", "Buraydah"),
    ("taif", "Taif"), ("الطائف", "Taif"),
    ("yanbu", "Yanbu"), ("ينبع", "Yanbu"),
    ("najran", "Najran"), ("نجران", "Najran"),
    ("jazan", "Jazan"), ("جازان", "Jazan"),
]

CITY_WORDS = [
    "Riyadh", "Jeddah", "Mecca", "Medina", "Dammam", "Khobar", "Dhahran", "Tabuk", "Abha",
    "Hail", "Buraydah", "Taif", "Yanbu", "Najran", "Jazan",
]

COUNTRY_NAME = "Saudi Arabia"
COUNTRY_SPELLINGS = ["saudi arabia", "ksa", "sa", "saudi", "المملكة العربية السعودية"]
COUNTRY_CODE = "966"

JUNK_VALUES = ["", "null", "undefined", "N/A", "n/a", "-", "—", "TBD", "TBA"]

GARBAGE_CELLS = ["[object Object]", "[]", "null", "undefined"]

GENERIC_NAMES = [
    "unknown company", "test company", "unnamed", "n/a", "company", "unknown",
    "test", "unnamed company", "no name",
]

GENERIC_TITLES = [
    "products", "product", "services", "service", "contact", "about", "home", "overview",
    "المنتجات", "منتجات", "خدمات", "الخدمات", "اتصل", "نبذة", "الرئيسية",
]

SLUG_STOP_WORDS = [
    "and", "the", "of", "for", "co", "corp", "ltd", "limited", "company",
    "saudi", "arabia", "wll", "fzc", "fze", "group", "industry", "industries",
    "trading", "contracting", "services", "manufacturing", "factory", "branch",
]

BUSINESS_TYPES = ["vendor", "manufacturer", "trader"]

# --- Fixed values: dimensions ---------------------------------------------------------------

# id, English name, Arabic name, slug
CATEGORIES = [
    ("1", "Industrial Equipment", "المعدات الصناعية", "industrial-equipment"),
    ("2", "Electrical", "الكهرباء", "electrical"),
    ("3", "Food Manufacturing", "تصنيع الأغذية", "food-manufacturing"),
    ("4", "Building Materials", "مواد البناء", "building-materials"),
    ("5", "Medical Supplies", "المستلزمات الطبية", "medical-supplies"),
    ("6", "Chemicals", "المواد الكيميائية", "chemicals"),
    ("7", "Automotive", "السيارات", "automotive"),
]

REGIONS = [
    ("1", "Riyadh Region", "منطقة الرياض", "riyadh-region"),
    ("2", "Makkah Region", "منطقة مكة المكرمة", "makkah-region"),
    ("3", "Eastern Province", "المنطقة الشرقية", "eastern-province"),
]

# id, region id, English name, Arabic name, slug
CITIES = [
    ("1", "1", "Riyadh", "الرياض", "riyadh"),
    ("2", "2", "Jeddah", "جدة", "jeddah"),
    ("3", "3", "Dammam", "الدمام", "dammam"),
]

RUN_REGIONS = ["me-central1", "us-central1", "europe-west1", "asia-east1"]

# --- Fixed values: scores ------------------------------------------------------------------

# weights of the confidence rubric in percent points
RUBRIC_WEIGHTS = {
    "name_en": 10, "name_ar": 5, "description_en": 8, "description_ar": 4, "business_type": 3,
    "any_email": 8, "phone": 7, "website_url": 8, "address": 4, "social": 3,
    "categories": 8, "two_categories": 4, "products": 4, "brands": 2, "fields": 2,
    "source_url": 6, "data_source": 4, "extraction_metadata": 3, "last_scraped_at": 3, "registry": 4,
}

PARKED_PHRASES = [
    "parked page", "this domain is for sale", "buy this domain",
    "domain parking", "registered by domain registrar",
    "privacy protection service", "whois privacy",
    "page not found", "under construction", "coming soon",
    "this website is for sale", "buy this website",
]

SPAM_PHRASES = ["casino", "viagra", "porn", "adult content", "online pharmacy", "weight loss", "replica watch"]

COMPANY_PAGE_WORDS = [
    "about", "contact", "products", "services", "company",
    "team", "leadership", "careers", "jobs", "news",
    "solutions", "portfolio", "clients", "partners",
]

# --- Fixed values: exports -----------------------------------------------------------------

EXPORT_FIELDS = [
    "id", "name_en", "name_ar", "slug", "business_type",
    "description_en", "description_ar",
    "website_url", "email", "phone", "city",
    "logo_url", "linkedin_url",
    "categories", "products",
    "is_verified", "status", "confidence_score",
    "created_at", "updated_at",
]

EXPORT_METADATA_FIELDS = [
    "source_url", "data_source", "extraction_metadata", "field_confidence", "master_id", "merged_from",
]

SITEMAP_PART_ROWS = 10_000

# --- Fixed values: enrichment --------------------------------------------------------------

ENRICHMENT_FIELDS = [
    "logo_url", "cover_image_url", "linkedin_url", "sales_email", "procurement_email",
    "phone", "email", "full_address",
    "seo_title_en", "seo_title_ar", "seo_description_en", "seo_description_ar",
    "description_en", "description_ar", "categories", "products", "fields",
    "instagram_url", "twitter_url", "facebook_url", "youtube_url", "tiktok_url",
    "locations", "services", "team_members", "extraction_method",
    "cr_number", "vat_number", "chamber_commerce_id", "is_vat_registered", "procurement_portal_url",
    "secondary_emails", "secondary_phones", "secondary_websites", "secondary_linkedin", "secondary_socials",
    "confidence_score",
]

PREFERRED_EVIDENCE_PAGE = [
    ("contact", ["email", "sales_email", "procurement_email", "phone", "whatsapp", "contact_email", "full_address"]),
    ("about", ["description_en", "description_ar", "name_en", "name_ar"]),
    ("products", ["products", "services", "categories", "fields"]),
]

DAILY_TOKEN_BUDGET = 5_000_000

# --- Fixed values: page extraction ----------------------------------------------------------

CARD_CLASSES = [
    "card", "listing", "company-item", "company-card", "result",
    "entry", "directory-item", "business-card", "vendor-card",
    "supplier-card", "partner-card", "item-card", "listing-card",
]
CARD_CLASS_PARTS = ["company", "listing", "vendor", "supplier", "business", "directory"]

CARD_SKIP_WORDS = [
    "home", "about", "contact", "login", "register", "signup", "sign up", "search", "cart",
    "menu", "footer", "header", "privacy", "terms",
]
TABLE_SKIP_WORDS = ["company", "name", "sr.", "no.", "#", "id", "action"]
LIST_SKIP_WORDS = ["home", "about", "contact", "login", "register", "search", "sitemap", "privacy", "terms"]

# column role -> words of the header cell, first role with a hit per column
HEADER_ROLES = [
    ("name", ["name", "company", "business", "establishment", "institution", "اسم", "شركة"]),
    ("registry", ["cr", "register", "license", "رقم"]),
    ("activity", ["activity", "type", "category", "نشاط"]),
    ("status", ["status", "state", "حالة"]),
    ("location", ["location", "city", "region", "مدينة"]),
]

REGISTRY_TABLE_IDS = ["companies", "businesses", "registry"]
REGISTRY_TABLE_CLASSES = ["companies", "businesses", "registry", "cr-list", "license-list", "member-list", "data-table", "results-table"]

EXCLUDED_IMAGE_HOSTS = [
    "facebook.com", "twitter.com", "linkedin.com", "instagram.com",
    "youtube.com", "google.com", "snapchat.com", "google-analytics.com",
    "googletagmanager.com", "cloudfront.net", "wp.com", "gravatar.com",
]

EXCLUDED_IMAGE_WORDS = [
    "facebook", "twitter", "linkedin", "instagram", "youtube", "snapchat",
    "social", "icon", "btn", "button", "loading", "spinner", "pixel",
    "google", "play-store", "app-store", "avatar", "user", "chamber",
    "mcci", "government", "fsc", "modon", "eamana", "vision2030",
]

# pages that stand for a refusal; marks count together with CHALLENGE_HOST
CHALLENGE_PHRASES = [
    "wait while we verify your browser", "perimeterx", "incapsula", "distil networks",
    "<title>403 forbidden</title>", "<title>access denied</title>", "<title>just a moment...</title>",
]
CHALLENGE_HOST = "cloudflare"
CHALLENGE_MARKS = ['id="challenge-running"', 'id="cf-challenge"', "__cf_chl_opt"]
FIREWALL_PHRASES = ["mod_security", "not acceptable", "access denied"]
EMPTY_PAGE_LENGTH = 200

ASSET_ENDINGS = ["jpg", "jpeg", "png", "gif", "pdf", "zip", "docx", "xlsx", "css", "js"]
PARKED_NAMES = ["parked", "for.?sale", "buy.?domain", "buy.?website", "domain.?name.?search", "whois"]
DETAIL_PAGE = r"(?i)/home/factorydetails/\d+"
FIRST_PUBLIC_ID = 100001

GENERIC_ASSET_PATHS = ["/assets/", "/static/", "/wp-content/themes/", "/header", "/footer", "/nav", "/theme/"]
DIRECTORY_WORDS = ["chamber", "mcci", "fsc", "modon", "eamana"]

PRODUCT_MARKERS = ["namely", "such as", "including", "like"]

# record line markers of the factory listing: start of a record, its name, its activity
RECORD_START = r"رقم\s*السجل\s*التجاري"
RECORD_NAME = "المصنع"
RECORD_ACTIVITY = r"^صنع\s+|الصناعات"
RECORD_NOISE = r"^(التفاصيل|بحث|السابق|التالي|\d+|إجمالي)"

MAIN_CONTENT_SELECTORS = [
    ("tag", "main"), ("role", "main"), ("tag", "article"), ("class", "post-content"), ("class", "entry-content"),
    ("class", "page-content"), ("class", "content"), ("id", "content"),
]
SIDE_TAGS = ["aside", "nav", "footer", "header"]
SIDE_CLASSES = ["sidebar", "widget", "menu", "navigation", "nav", "breadcrumb"]
HIDDEN_TAGS = ["script", "style", "nav", "footer", "header", "iframe", "noscript", "svg"]

PROFILE_NAME_ORDER = ["h3", "h2", "h4"]

# site family -> (words of which the address must hold one, further words, score with a further word, score without)
SITE_FAMILIES = [
    ("estate_portal", ["modon.gov.sa"], ["/factories", "/partners"], 0.97, 0.85),
    ("chamber", ["chamber", "chamber.sa", "mcci", "chamber.org.sa", "fsc.org.sa"], [], 0.95, 0.95),
    ("chamber", [".sa"], ["/member", "/directory", "/business", "/companies", "/factories"], 0.7, 0.0),
    (
        "registry", [".gov.sa", "monshaat.gov.sa"],
        ["/companies", "/business", "/registry", "/register", "/cr", "/commercial", "/license", "/member"], 0.95, 0.8,
    ),
    (
        "b2b_portal",
        [
            "saudiexporters.com", "saudibusiness.com", "sauditraders.com", "industry.com.sa", "kompass.com", "alibaba.com",
            "made-in-china.com", "globalsources.com", "ec21.com", "tradekey.com", "exportersindia.com",
            "saudiyellowpages.com", "saudibusinessdirectory.com",
        ],
        [], 0.9, 0.9,
    ),
    ("b2b_portal", ["/companies/", "/suppliers/", "/manufacturers/", "/vendors/", "/business-directory"], [], 0.6, 0.6),
    ("directory", ["ksa.directory", "saudidir.com"], [], 0.95, 0.95),
    ("world_listing", ["cybo.com"], [], 0.95, 0.95),
    ("mideast_listing", ["bizmideast.com"], [], 0.95, 0.95),
    ("industry_guide", ["saudiindustryguide.com"], [], 0.95, 0.95),
]
GENERIC_SCORE = 0.05
MODEL_SCORE = 0.02

B2B_CARD_CLASSES = [
    "company-card", "supplier-card", "manufacturer-card", "vendor-card", "business-card", "listing-card",
    "company-item", "supplier-item", "manufacturer-item", "company-listing", "supplier-listing", "manufacturer-listing",
    "result-item", "search-result", "company-result", "company-box", "supplier-box", "manufacturer-box",
    "col-company", "company-col",
]
DIRECTORY_CARD_CLASSES = [
    "company-card", "business-card", "listing-card", "company-item", "business-item", "listing-item",
    "result-item", "search-result", "company-box", "business-box", "company-listing", "business-listing",
]
LABELLED_CARD_CLASSES = [
    "company-card", "member-card", "business-card", "company-item", "member-item", "listing-item", "card-pro", "blog_post",
]
LABEL_WORDS = ["المصنع", "الاسم", "الشركة", "المنشأة"]
REGISTRY_WORDS = ["السجل", "رقم", "الضريبي"]
PORTAL_CARD_CLASSES = ["ms-List-cell", "ms-DetailsRow", "ms-TilesList-cell"]
PORTAL_CARD_PARTS = ["factory-card", "factoryCard", "Factory", "company-card", "CompanyCard"]
PORTAL_ZONE_IDS = ["DeltaPlaceHolderMain", "ctl00_PlaceHolderMain", "WebPartWPQ1", "WebPartWPQ2"]
NAVIGATION_WORDS = [
    "home", "about", "contact", "search", "login", "sign in", "sign up",
    "english", "arabic", "ar", "en", "sitemap", "privacy", "terms",
    "الرئيسية", "عن", "تواصل", "بحث", "دخول",
]
HEADING_WORDS = [
    "factories", "factory", "companies", "partners", "our partners",
    "search", "filter", "results", "list", "directory", "industrial",
    "المصانع", "الشركاء", "بحث", "نتائج", "قائمة",
]
SECTION_SKIP = (
    r"(?i)^(select page|saudi industry guide|products?|services?|our mission|mission|vision|about|contact)$"
    r"|^(المنتجات|منتجات|الخدمات|خدمات|رسالتنا|عن\s+الشركة|اتصل\s+بنا)$"
)
