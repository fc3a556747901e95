"""Addresses, enums, limits and word lists that results depend on."""

# --- fixed values: sections the application renders itself, and the section each one shows
FIXED_SECTIONS = {
    "sklep-nurkowy": "shop",
    "kursy-nurkowania": "courses",
    "kursy-nurkowania/kursy-nurkowania-padi-warszawa": "courses",
    "kontakt": "contact",
    "wyprawy": "trips",
    "wyprawy-nurkowe": "trips",
    "kalendarz": "calendar",
    "aktualnosci": "news",
    "relacje": "reports",
    "relacje-z-wypraw": "reports",
    "galerie": "albums",
    "galeria": "albums",
}
# --- fixed values: canonical address per section
SECTION_PATHS = {
    "shop": "/sklep-nurkowy.html",
    "courses": "/kursy-nurkowania/kursy-nurkowania-padi-warszawa.html",
    "contact": "/kontakt.html",
    "trips": "/wyprawy-nurkowe.html",
    "calendar": "/kalendarz.html",
    "news": "/aktualnosci.html",
    "reports": "/relacje-z-wypraw.html",
    "albums": "/galeria.html",
}
# --- fixed values: first segments served by the application
APP_SEGMENTS = ["koszyk", "newsletter", "zgloszenie", "platnosc-testowa", "api", "admin", "media", "_next"]
APP_EXACT = ["", "index", "index.php"]
# --- fixed values: first segments that are never a public search address
NON_PUBLIC_SEGMENTS = ["login", "logout", "logowanie", "rejestracja", "reset", "remind", "token", "robots", "sitemap", "favicon"]
COURSE_PREFIX = "kursy-nurkowania"
SHOP_ROOT = "sklep-nurkowy"
SITE_ZONE = "Europe/Warsaw"

# --- fixed values: collections in write order, and the order in which kinds win an address
COLLECTIONS = ["categories", "products", "courses", "course-sessions", "pages", "trips", "albums", "events", "redirects"]
KIND_ORDER = ["product", "category", "course", "page", "trip", "album", "event"]
CALENDAR_KINDS = ["event", "course", "trip"]
DISPOSITIONS = ["retained200", "redirect301", "unresolved404", "review"]

# --- fixed values: limits
MAX_HTML_CHARS = 8 * 1024 * 1024
MAX_PATH = 2048
MAX_SEGMENTS = 12
MAX_SEGMENT_UNITS = 200
MAX_HOPS = 20
MAX_FRONTIER = 20_000
MAX_FRONTIER_SAMPLE = 100
MAX_RELATIONS = 500
MAX_UNRESOLVED = 10_000
MAX_CART_LINES = 50
MAX_QTY = 99
MAX_CENTS = 100_000_000
MAX_STOCK = 1_000_000
SITEMAP_SHARD = 50_000
PAGE_SIZE = 24
TAIL_EVENTS = 50
ONLINE_RESERVATION_MINUTES = 30
OFFLINE_RESERVATION_MINUTES = (60, 20_160)
SEAT_RESERVATION_MINUTES = 30
NEWSLETTER_HOURS = 24
EXPIRY_BATCH = 200

# --- fixed values: causes of an open migration decision, most specific first
DECISION_CAUSES = [
    "conflicting-source-content", "calendar-navigation-excluded", "shop-component-missing",
    "product-category-unresolved", "product-ambiguous-name", "product-missing-price", "album-missing-title",
    "field-invalid", "missing-title", "source-error-response", "legacy-account-requires-source-database",
]
# --- fixed values: Polish month names (nominative for dates in pages, genitive for display) and weekdays
MONTHS_NOMINATIVE = ["styczeń", "luty", "marzec", "kwiecień", "maj", "czerwiec", "lipiec", "sierpień", "wrzesień", "październik", "listopad", "grudzień"]
MONTHS_GENITIVE = ["stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września", "października", "listopada", "grudnia"]
WEEKDAYS = ["Poniedziałek", "Wtorek", "Środa", "Czwartek", "Piątek", "Sobota", "Niedziela"]
# --- fixed values: photo extensions and folders
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "gif", "avif"]
ASSET_FOLDERS = ["templates/", "media/", "modules/", "plugins/", "components/", "administrator/", "cache/", "libraries/"]
PRODUCT_IMAGE_FOLDERS = ["components/com_virtuemart_images/shop_image/product/", "components/com_virtuemart/shop_image/product/"]
