"""Fixed values.

Every literal below is part of the behaviour that results must reproduce: word
lists, marker names, thresholds, weights and text patterns.  They are data.
"""

# --- domain rules (fixed values) ---------------------------------------------
INFRA_SUFFIXES = """
amazonaws.com azurewebsites.net cloudapp.azure.com cloudflare.com cloudflaressl.com cloudfront.net
digitaloceanspaces.com elasticbeanstalk.com fastly.net firebaseapp.com githubusercontent.com github.io
gitlab.io googleapis.com googleusercontent.com herokuapp.com herokudns.com netlify.app netlify.com ngrok.io
onmicrosoft.com pages.dev railway.app render.com repl.co sendgrid.net shopifycdn.com shopifypreview.com
sslip.io storage.googleapis.com trafficmanager.net vercel.app web.app workers.dev wpengine.com zendesk.com
""".split()

BLOCKED_SUFFIXES = "gov edu mil int arpa gov.uk ac.uk edu.au gov.au".split()

TWO_PART_SUFFIXES = """
co.uk org.uk me.uk ltd.uk plc.uk com.au net.au org.au co.nz net.nz org.nz com.br com.mx com.ar com.co com.pe
co.za co.il co.in co.id co.kr co.jp co.th com.tr net.tr org.tr com.sg com.my com.ph com.vn com.hk com.tw
com.pl com.ua com.es com.pt com.gr com.ro com.sa com.eg com.ng com.pk com.bd
""".split()

NOISE_LABELS = """
mail smtp imap pop webmail mx autodiscover autoconfig ns1 ns2 dns vpn ftp sftp cpanel whm webdisk
api cdn static assets img images media dev test staging stage preview beta demo sandbox
admin portal intranet git jenkins grafana kibana monitoring status mailer track click link email
""".split()

# --- queue states and storefront markers (fixed values) ----------------------
STATUS_PENDING = "pending"
STATUS_STORE = "shopify"
STATUS_NOT_STORE = "not_shopify"
STATUS_ERROR = "error"
STORE_IP_PREFIX = "23.227.38."
STORE_HEADERS = ["x-shopid", "x-shopify-stage"]
META_DOMAIN_FIELD = "myshopify_domain"
SOURCE_CT_LOG = "ct_log"
SOURCE_CERT_STREAM = "certstream"
SOURCE_MANUAL = "manual"
MAX_ATTEMPTS = 3

# --- crawl policy (fixed values) ---------------------------------------------
REVISIT_DAYS = {1: 1, 2: 2, 3: 3, 4: 5}
REVISIT_DAYS_OTHER = 7
FRESH_DAYS = 2
NEW_STORE_DAYS = 30
RECENT_DAYS = 7
CHART_DAYS = 30
CONTEXT_MAX_AGE_DAYS = 14
HISTORY_KEEP_DAYS = 400
SPREAD_KEEP_DAYS = 120
QUEUE_KEEP_DAYS = 30
CT_BATCH = 256
PAGE_PRODUCTS = 250
BACKOFF_STATUSES = [429, 503]
BACKOFF_HOURS = 24

# --- categorisation (fixed values) -------------------------------------------
UNCATEGORIZED = "uncategorized"
PRODUCT_MIN_SCORE = 0.35
STORE_MIN_SCORE = 0.14
PART_WEIGHTS = {"name": 0.7, "description": 0.8, "type": 1.4, "title": 1.0}
TYPE_COUNT_CAP = 200
GENERIC_TYPES = [
    "simple", "downloadable", "virtual", "simple, downloadable, virtual", "default", "product", "products",
    "all products", "all", "untitled", "misc", "other", "genel", "diger", "variable",
]

# --- title noise patterns (fixed values) -------------------------------------
MEASURE_PATTERN = (
    r"\b\d+(?:[.,]\d+)?\s*(?:x\s*\d+(?:[.,]\d+)?\s*)*"
    r"(?:cm|mm|m|kg|gr?|ml|l|lb|oz|inch|in|\"|''|luni|ani|years?|months?)\b"
)
MODEL_CODE_PATTERN = r"\b(?=[A-Z0-9-]*\d)[A-Z0-9][A-Z0-9-]{4,}\b"
PUNCT_RUN_PATTERN = r"[\s,;|/·•\-–—]{2,}"

# --- matching and ranking (fixed values) -------------------------------------
MAX_HASH_DISTANCE = 6
SECONDS_PER_EXTRA_STORE = 172800
FACET_LIMITS = {"country": 60, "currency": 40, "category": 40, "niche": 250, "tld": 30}
SITE_INDEX_ROWS = 20000

# --- Unicode white space (fixed values) --------------------------------------
WHITE_SPACE = (
    " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
