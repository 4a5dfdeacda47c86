"""Word lists, patterns and tables that results depend on. All are defaults that callers may replace."""

EMAIL_SHAPE = r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+$"
EMAIL_FOUND = r"\b[A-Za-z0-9._%+\-']+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
NOISE_EMAIL_PARTS = ("example.com", "test.com", "domain.com", "placeholder", "email.com", "yourname", "youremail", "name@")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg")
URL_SHAPE = r"(?i)^(https?://)?([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}.*$"

NOISE_NAMES = (
    "home", "about", "about us", "contact", "contact us", "services", "pricing", "login", "sign in", "vendors", "businesses", "companies",
    "directory", "categories", "featured", "popular", "recommended", "search results", "view profile", "read more", "learn more",
)
RANKING_STARTS, RANKING_TERMS = ("best ", "top "), ("vendors", "companies", "businesses", "services")
TRAILING_NAV = ("home", "about us", "contact us", "pricing", "services")
NOT_A_NAME = ("street", "road", "avenue", "lagos", "abuja", "nigeria", "phone", "email", "address", "price", "from")

ADDRESS_HINTS = r"street|st\.?|road|rd\.?|avenue|ave\.?|close|crescent|drive|dr\.?|suite|floor|plot|block|estate|plaza|complex|junction|lagos|abuja|kano|ibadan|port harcourt|nigeria|address|office|location|venue"
ADDRESS_LABELS = r"\b(address|office|location|venue|branch)\b\s*:?"
STATES = "lagos|abuja|fct|kano|kaduna|rivers|oyo|ogun|enugu|edo|delta|akwa ibom|cross river|kwara|osun|ondo|anambra|imo|abia|plateau|nigeria"

PHONE_FOUND = r"(?:\+\d{1,3}[\s().-]?)?(?:\(?\d{2,5}\)?[\s().-]?){2,5}\d{2,5}"
#: Region: trunk prefix, digits with it, country code.
TRUNKS = {
    "AU": ("0", 10, "61"), "DE": ("0", 12, "49"), "FR": ("0", 10, "33"), "GB": ("0", 11, "44"), "GH": ("0", 10, "233"), "IN": ("0", 11, "91"),
    "KE": ("0", 10, "254"), "NG": ("0", 11, "234"), "ZA": ("0", 10, "27"),
}

ASSET_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".pdf", ".zip", ".css", ".js", ".ico", ".woff", ".woff2", ".ttf")
SKIPPED_IN_URLS = ("login", "signin", "sign-in", "register", "cart", "checkout", "privacy", "terms", "cookie", "logout", "account", "wp-admin", "feed", "rss")
DISCOVERY_WORDS = (
    "company", "companies", "profile", "business", "vendor", "listing", "directory", "about", "contact", "pricing", "packages",
    "services", "detail", "details", "shop", "store", "branch", "location", "locations", "page",
)
PAGINATION = ("page=", "/page/", "paged=", "pagenum=", "offset=")
PRIORITY_PATHS = ("/contact", "/about", "/pricing", "/team", "/company", "/profile")
BUSINESS_WORDS = ("address", "location", "business", "vendor", "package", "quote", "fee", "cost")
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "tiktok.com")

CURRENCIES = {"₦": "NGN", "$": "USD", "£": "GBP", "€": "EUR", "NGN": "NGN", "N": "NGN", "USD": "USD", "GBP": "GBP"}
PRICE = r"(?i)(NGN|USD|GBP|N|₦|\$|£|€)\s?(\d[\d,]*(?:\.\d{1,2})?)"
STARTING = r"(?i)\b(starting from|starts at|from|as low as|packages? from|fees?)\b"
