"""Word lists, lookup tables, limits and formats.

These must equal the values of the system whose results this library matches,
so they are kept here as plain text, in one place.  Everything is a parameter
default: operators accept other lists.
"""

from __future__ import annotations

# --- URLs (fixed values) -----------------------------------------------------

TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "utm_id", "utm_name", "utm_reader",
    "gclid", "fbclid", "msclkid", "dclid", "yclid",
    "mc_cid", "mc_eid", "igshid", "ref", "ref_src", "ref_url", "_ga", "_gl",
]

DOWNLOADABLE_EXTENSIONS = [
    ".pdf", ".epub", ".mobi", ".azw3", ".fb2",
    ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".ods", ".odp", ".rtf", ".txt", ".md",
    ".csv", ".tsv", ".jsonl", ".json", ".xml", ".parquet", ".srt", ".vtt",
    ".zip", ".tar", ".gz", ".rar", ".7z", ".bz2", ".xz",
    ".mp4", ".mkv", ".webm", ".mov", ".avi", ".flv",
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tiff", ".heic",
]

THEME_ASSET_EXTENSIONS = [".css", ".js", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot"]

DRIVE_EXTENSIONS = [".pdf", ".docx", ".zip", ".xlsx", ".epub"]

TRUSTED_CDN_DOMAINS = [
    "cdn.gov.krd", "gov.krd", "kurdipedia.org", "usrfiles.com", "wixstatic.com", "wix.com",
    "wixsite.com", "vercel-storage.com", "amazonaws.com", "googleapis.com", "drive.google.com",
    "docs.google.com", "cloudflarestorage.com", "r2.dev", "cloudinary.com", "archive.org",
    "dropbox.com", "mediafire.com", "wikimedia.org", "githubusercontent.com",
]

BLOCKED_HOSTS = ["localhost", "metadata.google.internal"]

DOCUMENT_CDN_BASE = "https://usrfiles.com/"

SCRIPT_PAGE_EXTENSIONS = [".php", ".asp", ".aspx", ".jsp", ".cgi", ".html", ".htm", ".cfm"]

# --- HTML (fixed values) -----------------------------------------------------

FURNITURE_TAGS = ["script", "style", "noscript", "iframe", "svg", "header", "footer", "nav"]
FURNITURE_CLASSES = ["text-nav", "nav", "footer", "header", "sidebar", "menu"]
MAIN_CONTAINERS = [
    ("id", "textbody"), ("class", "textcontent"), ("tag", "article"), ("tag", "main"),
    ("class", "post-content"), ("class", "entry-content"), ("class", "article-body"),
    ("class", "text-container"),
]
ACCORDION_CLASSES = ["accordion-header", "accordion-button", "card-header", "panel-heading"]
HEADING_CLASSES = ["title", "headline", "card-title", "publication-title"]

LINK_ATTRIBUTES = ["data-href", "data-url", "data-link", "data-document-url", "data-uri"]

RESOURCE_TAG_ATTRIBUTES = [
    ("img", "src"), ("img", "srcset"), ("source", "src"), ("source", "srcset"), ("video", "src"),
    ("video", "poster"), ("audio", "src"), ("iframe", "src"), ("embed", "src"), ("object", "data"),
    ("image", "href"), ("use", "href"),
]
RESOURCE_META_KEYS = [
    ("property", "og:image"), ("property", "og:image:secure_url"), ("property", "og:video"),
    ("name", "twitter:image"), ("name", "twitter:image:src"),
    ("itemprop", "image"), ("itemprop", "thumbnailUrl"), ("itemprop", "contentUrl"),
]
RESOURCE_DATA_ATTRIBUTES = [
    "data-src", "data-srcset", "data-original", "data-lazy-src", "data-lazy", "data-lazysrc",
    "data-lazy-srcset", "data-original-src", "data-fallback-src", "data-echo-src", "data-cfsrc",
    "data-image", "data-img", "data-img-url", "data-image-url", "data-full", "data-full-url",
    "data-thumb", "data-thumbnail", "data-zoom-src", "data-zoom-image", "data-lightbox-src",
    "data-mfp-src", "data-bg", "data-bgimage", "data-bg-img", "data-bg-src", "data-background",
    "data-background-image", "data-file", "data-download", "data-url", "data-document-url",
    "data-media-id", "data-uri", "data-wix-media-id",
]
ENCLOSURE_RELS = ["alternate", "enclosure"]
ENCLOSURE_AS = ["image", "video", "media", "document"]

INLINE_URL_EXTENSIONS = [
    "pdf", "docx?", "xlsx?", "pptx?", "odt", "ods", "odp", "epub", "mobi", "azw3", "zip", "rar",
    "7z", "tar", "gz", "mp3", "mp4", "wav", "flac", "ogg", "opus", "mkv", "webm", "mov", "avi",
    "jpg", "jpeg", "png", "gif", "webp", "svg", "csv", "json", "jsonl", "xml", "txt", "srt", "vtt",
    "parquet", "tsv",
]
INLINE_DOCUMENT_EXTENSIONS = ["pdf", "epub", "mobi", "docx", "xlsx", "zip", "mp3", "rar"]

JSON_URL_KEYS = [
    "file_url", "pdf_url", "download_url", "audio_file_url", "url", "file", "path", "src", "link",
    "cover_image_url", "documenturl", "mediaid", "uri", "originalfilename", "image",
    "thumbnailurl", "contenturl", "logo", "screenshot", "haspart",
]
JSON_RELATIVE_EXTENSIONS = [
    ".pdf", ".epub", ".mobi", ".azw3", ".mp3", ".docx", ".xlsx", ".zip", ".rar",
]

PAGE_DOWNLOAD_EXTENSIONS = [
    ".pdf", ".epub", ".mobi", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".zip", ".rar", ".mp4",
]

GATE_PHRASES = [
    "access denied", "page not found", "404 not found", "sign in to continue",
    "log in to continue", "enable javascript to continue", "accept cookies to continue",
]

# --- Files (fixed values) ----------------------------------------------------

#: extension -> category
EXTENSION_CATEGORIES = {
    ".pdf": "pdf",
    ".doc": "documents", ".docx": "documents", ".odt": "documents", ".rtf": "documents",
    ".pages": "documents",
    ".xls": "spreadsheets", ".xlsx": "spreadsheets", ".ods": "spreadsheets", ".csv": "spreadsheets",
    ".tsv": "spreadsheets",
    ".ppt": "presentations", ".pptx": "presentations", ".odp": "presentations",
    ".zip": "archives", ".rar": "archives", ".7z": "archives", ".tar": "archives", ".gz": "archives",
    ".bz2": "archives", ".xz": "archives", ".iso": "archives",
    ".txt": "text", ".md": "text", ".rst": "text",
    ".epub": "ebooks", ".mobi": "ebooks", ".azw3": "ebooks", ".fb2": "ebooks", ".djvu": "ebooks",
    ".cbz": "ebooks", ".cbr": "ebooks", ".chm": "ebooks",
    ".mp3": "audio", ".m4a": "audio", ".wav": "audio", ".flac": "audio", ".ogg": "audio", ".opus": "audio",
    ".aac": "audio", ".wma": "audio",
    ".mp4": "video", ".mkv": "video", ".avi": "video", ".mov": "video", ".webm": "video", ".flv": "video",
    ".wmv": "video", ".m4v": "video",
    ".jpg": "images", ".jpeg": "images", ".png": "images", ".gif": "images", ".webp": "images",
    ".svg": "images", ".bmp": "images", ".ico": "images",
    ".srt": "subtitles", ".vtt": "subtitles",
    ".json": "data", ".jsonl": "data", ".xml": "data", ".parquet": "data", ".arrow": "data",
    ".feather": "data",
    ".py": "code", ".js": "code", ".ts": "code", ".html": "code", ".css": "code", ".sql": "code",
    ".yaml": "code", ".yml": "code",
}

BROWSER_CATEGORY_EXTENSIONS = {
    "ebooks": ["epub", "mobi", "azw3", "fb2", "djvu", "cbz", "cbr", "chm"],
    "documents": ["doc", "docx", "odt", "rtf", "txt", "md", "pages"],
    "audio": ["mp3", "wav", "flac", "m4a", "ogg", "opus", "aac"],
    "video": ["mp4", "mkv", "avi", "mov", "webm", "flv"],
    "images": ["jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "ico"],
    "data": ["parquet", "jsonl", "csv", "tsv", "json", "xml"],
    "archives": ["zip", "rar", "7z", "tar", "gz", "bz2", "xz"],
}

MIME_EXTENSIONS = {
    "application/pdf": ".pdf",
    "application/epub+zip": ".epub",
    "application/x-mobipocket-ebook": ".mobi",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
    "application/zip": ".zip",
    "application/x-rar-compressed": ".rar",
    "application/x-7z-compressed": ".7z",
    "application/x-tar": ".tar",
    "application/gzip": ".gz",
    "audio/mpeg": ".mp3",
    "audio/mp3": ".mp3",
    "audio/wav": ".wav",
    "audio/x-wav": ".wav",
    "audio/flac": ".flac",
    "audio/ogg": ".ogg",
    "audio/opus": ".opus",
    "audio/mp4": ".m4a",
    "audio/x-m4a": ".m4a",
    "audio/aac": ".aac",
    "video/mp4": ".mp4",
    "video/x-matroska": ".mkv",
    "video/webm": ".webm",
    "video/quicktime": ".mov",
    "video/x-msvideo": ".avi",
    "image/jpeg": ".jpg",
    "image/png": ".png",
    "image/webp": ".webp",
    "image/gif": ".gif",
    "image/svg+xml": ".svg",
    "application/json": ".json",
    "text/csv": ".csv",
    "application/xml": ".xml",
    "text/plain": ".txt",
    "application/x-parquet": ".parquet",
}

DYNAMIC_PAGE_EXTENSIONS = [
    ".php", ".asp", ".aspx", ".jsp", ".cgi", ".cfm", ".htm", ".html", ".action", ".do", ".ashx",
]

GENERIC_BINARY_MIMES = ["application/octet-stream", "binary/octet-stream"]

SERVED_MIME_TYPES = {
    ".json": "application/json; charset=utf-8",
    ".jsonl": "application/x-ndjson; charset=utf-8",
    ".pdf": "application/pdf",
    ".txt": "text/plain; charset=utf-8",
    ".md": "text/markdown; charset=utf-8",
    ".csv": "text/csv; charset=utf-8",
    ".epub": "application/epub+zip",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".webp": "image/webp",
    ".mp3": "audio/mpeg",
    ".mp4": "video/mp4",
}

DISK_MIME_TYPES = {
    ".pdf": "application/pdf",
    ".json": "application/json",
    ".html": "text/html; charset=utf-8",
    ".htm": "text/html; charset=utf-8",
    ".txt": "text/plain; charset=utf-8",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".webp": "image/webp",
    ".mp3": "audio/mpeg",
    ".mp4": "video/mp4",
}

#: (hex prefix of the content, byte offset, type)
MAGIC_SIGNATURES = [
    ("255044462D", 0, "application/pdf"),
    ("89504E470D0A1A0A", 0, "image/png"),
    ("FFD8FF", 0, "image/jpeg"),
    ("474946383761", 0, "image/gif"),
    ("474946383961", 0, "image/gif"),
    ("57454250", 8, "image/webp"),
    ("526172211A07", 0, "application/x-rar"),
    ("377ABCAF271C", 0, "application/x-7z-compressed"),
    ("1F8B", 0, "application/gzip"),
    ("425A68", 0, "application/x-bzip2"),
    ("FD377A585A00", 0, "application/x-xz"),
    ("D0CF11E0A1B11AE1", 0, "application/x-ole-storage"),
    ("494433", 0, "audio/mpeg"),
    ("664C6143", 0, "audio/flac"),
    ("4F676753", 0, "audio/ogg"),
    ("66747970", 4, "video/mp4"),
    ("1A45DFA3", 0, "video/x-matroska"),
    ("504B0304", 0, "application/zip"),
]

GENERIC_TITLES = [
    "untitled", "document", "microsoft word", "word document", "print", "scan", "adobe indesign",
    "pdf document", "download", "file", "blank", "new document", "page", "home", "index",
    "داگرتن", "کلیک بکە", "فایل",
]

RETRYABLE_MARKERS = [
    "401", "403", "429", "500", "502", "503", "504", "Timeout", "ConnectError", "ConnectionReset",
]

MAX_FILE_BYTES = 500 * 1024 * 1024

EXTENSION_PRESETS = {
    "articles": [".html", ".json"],
    "books": [".pdf", ".epub", ".mobi", ".azw3", ".fb2", ".djvu"],
    "documents": [".pdf", ".doc", ".docx", ".odt", ".rtf", ".txt", ".md", ".pages"],
    "datasets": [".parquet", ".jsonl", ".csv", ".tsv", ".json", ".xml", ".arrow"],
    "video": [".mp4", ".mkv", ".avi", ".mov", ".webm"],
    "images": [".jpg", ".jpeg", ".png", ".webp", ".svg", ".gif"],
    "archives": [".zip", ".rar", ".7z", ".tar", ".gz"],
}

#: slug fragment(s) -> display name, first match wins
#: (test, parts of a slug, name): the slug contains all parts, or equals the one part
KNOWN_SOURCE_NAMES = [
    ("contains", ["basnews"], "BasNews"),
    ("contains", ["kurdishcentral"], "Kurdish Central"),
    ("contains", ["diyako", "yageyziman"], "Diyako (Yagey Ziman)"),
    ("contains", ["yageyziman"], "Yagey Ziman"),
    ("equals", ["gov-krd"], "Gov.krd (Kurdistan Regional Government)"),
    ("equals", ["gov.krd"], "Gov.krd (Kurdistan Regional Government)"),
    ("contains", ["rudaw"], "Rudaw"),
]
SLUG_TLDS = ["com", "org", "net", "krd", "iq", "edu", "info", "io", "ai", "me", "tv"]

# --- Catalog vocabularies (fixed values) ------------------------------------

RUN_STATUSES = [
    "PENDING", "RUNNING", "PAUSED", "COMPLETED", "FAILED", "CANCEL_REQUESTED", "CANCELLED",
]
REPORTED_RUN_STATUSES = [
    "PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCEL_REQUESTED", "CANCELLED",
]
TERMINAL_STATUSES = ["COMPLETED", "FAILED", "CANCELLED"]
FILE_STATUSES = ["DISCOVERED", "DOWNLOADING", "UPLOADED", "DUPLICATE", "SKIPPED", "FAILED"]
APPROVAL_STATUSES = ["PENDING", "APPROVED", "REJECTED"]
ERROR_CODES = [
    "NETWORK_ERROR", "TIMEOUT", "HTTP_ERROR", "RATE_LIMITED", "FORBIDDEN", "NOT_FOUND",
    "INVALID_CONTENT", "FILE_TOO_LARGE", "UNSUPPORTED_TYPE", "HASH_ERROR", "R2_UPLOAD_ERROR",
    "DATABASE_ERROR", "CANCELLED", "UNKNOWN",
]
COLLECTOR_TYPES = ["WEB", "TELEGRAM", "MEDIA", "API", "APP", "MANUAL", "EXTERNAL"]
MEDIA_KINDS = ["photo", "video", "audio", "document"]

CATEGORY_FILTERS = {
    "pdf": {"ext": ["pdf"], "mime_has": ["pdf"], "key_has_ci": ["/pdf/"]},
    "digital": {"key_has": ["/pdf/digital/", "/pdf/native/decoded/", "/pdf/native/"]},
    "ocr": {"key_has": ["/pdf/ocr/", "/ocr/"]},
    "web_data": {"key_has": ["/data/web_content/", "/web_content/"]},
    "ebooks": {
        "ext": ["epub", "mobi", "azw3", "fb2", "djvu", "pdf"],
        "mime": ["application/epub+zip", "application/x-mobipocket-ebook", "application/pdf"],
    },
    "documents": {
        "ext": ["pdf", "doc", "docx", "odt", "rtf", "txt", "md"],
        "dotted_only": [".pages"],
        "mime": [
            "application/pdf", "application/msword",
            "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
            "text/plain",
        ],
    },
    "audio": {
        "mime_prefix": "audio/",
        "ext": ["mp3", "wav", "flac", "ogg", "opus", "m4a", "aac"],
    },
    "video": {"mime_prefix": "video/", "ext": ["mp4", "mkv", "avi", "mov", "webm"]},
    "images": {"mime_prefix": "image/", "ext": ["jpg", "jpeg", "png", "webp", "svg", "gif"]},
    "datasets": {
        "ext": ["parquet", "jsonl", "csv", "tsv", "json", "xml", "arrow"],
        "mime": ["application/json", "application/jsonlines", "text/csv", "application/xml"],
    },
}
CATEGORY_FILTER_ALIASES = {
    "pdf_digital": "digital", "digital_pdf": "digital", "pdf_ocr": "ocr", "ocr_pdf": "ocr",
    "web": "web_data", "articles": "web_data", "books": "ebooks",
}

KEEP_CATEGORIES = {
    "pdf": {"ext": [".pdf"], "mime_has": "pdf"},
    "ebooks": {"ext": [".epub", ".mobi", ".azw3", ".fb2", ".djvu", ".pdf"]},
    "documents": {"ext": [".pdf", ".doc", ".docx", ".odt", ".rtf", ".txt", ".md"]},
    "audio": {
        "ext": [".mp3", ".wav", ".flac", ".ogg", ".opus", ".m4a", ".aac"], "mime_prefix": "audio/",
    },
    "video": {"ext": [".mp4", ".mkv", ".avi", ".mov", ".webm"], "mime_prefix": "video/"},
    "images": {
        "ext": [".jpg", ".jpeg", ".png", ".webp", ".svg", ".gif"], "mime_prefix": "image/",
    },
    "datasets": {"ext": [".parquet", ".jsonl", ".csv", ".tsv", ".json", ".xml"]},
}

# --- Text (fixed values) -----------------------------------------------------

#: Latin-1 letters of the legacy font and the letters they stand for.
LEGACY_LETTERS = "àáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ"
LEGACY_TARGETS = "ەابپتجچحخدرڕزژسشعغفڤقکگلڵمنوۆیێێ"

#: Arabic, Persian and Urdu letter forms and their Kurdish counterparts.
ARABIC_FORMS = "كيىےہ"
KURDISH_FORMS = "کییێە"

WORD_REPAIRS = [
    ("کرتی", "کەرتی"),
    ("تایبت", "تایبەت"),
    ("تیدا", "تێدا"),
    ("تیدایە", "تێدایە"),
    ("هروەها", "هەروەها"),
    ("برامبر", "بەرامبەر"),
    ("برامبەری", "بەرامبەری"),
    ("کارام", "کارامە"),
    ("ئگر", "ئەگەر"),
    ("بکاریان", "بەکاریان"),
    ("بخن", "بخەن"),
    ("بدۆزنوە", "بدۆزنەوە"),
    ("بگوزنوە", "بگوازرێنەوە"),
    ("پاداشت", "پاداشت"),
    ("خاوەنکاران", "خاوەنکاران"),
    ("کارمندان", "کارمندان"),
    ("کارمندی", "کارمندی"),
]
#: letters after which a missing vowel is restored before the ending -we
VOWEL_REPAIR_LETTERS = ["ن", "ر", "ت"]

KURDISH_LETTERS = "ەێۆڕڵڤگکیانۆۆو"
#: letters that standard Arabic does not use; for the strict alphabet option
STRICT_KURDISH_LETTERS = "ەێۆڕڵڤگکپچژ"

ARABIC_CLASS = r"[\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
LATIN_CLASS = r"[A-Za-z\x{C0}-\x{24F}]"
CYRILLIC_CLASS = r"[\x{400}-\x{4FF}]"
DEVANAGARI_CLASS = r"[\x{900}-\x{97F}]"

LANGUAGE_NAMES = {
    "ckb": "Central Kurdish (Sorani)",
    "ku": "Kurdish",
    "ar": "Arabic",
    "en": "English",
    "tr": "Turkish",
    "fa": "Persian (Farsi)",
    "ur": "Urdu",
    "he": "Hebrew",
    "unknown": "Unknown",
}

MOJIBAKE_PATTERNS = [
    "Ã[\\x{80}-\\x{bf}]",
    "â€[™\"']",
    "Â[\\x{80}-\\x{bf}]",
    "\\x{c3}[\\x{80}-\\x{bf}]{2}",
    "\\x{fffd}{2,}",
]

QUALITY_WEIGHTS = {
    "text_density": 0.25,
    "printable_ratio": 0.15,
    "encoding_quality": 0.30,
    "metadata_completeness": 0.15,
    "file_integrity": 0.15,
}
METADATA_FIELDS = ["title", "author", "subject", "language", "date", "topic"]
PDF_DENSITY_STEPS = [(150, 1.0), (100, 0.85), (50, 0.6), (20, 0.3)]
TEXT_DENSITY_STEPS = [(500, 1.0), (300, 0.85), (100, 0.6), (30, 0.3)]
DENSITY_FLOOR = 0.1

#: topic -> (primary keywords, secondary keywords), in tie-break order
TOPIC_KEYWORDS = {
    "history": (
        ["مێژوو", "تاریخ", "جنگ", "کشتی", "بەکوکدان", "شەون", "دوخ", "گەلەک", "سەدە", "سال",
         "ڕووداو", "پەشین", "دواتر", "بەرامبەر", "لەمەوپێش"],
        ["تاریخی", "باسێن", "نووان", "بنەما", "پەیوەندی", "گوتیار", "کون", "نووی"],
    ),
    "law": (
        ["یاسا", "قانون", "دادگا", "ڕەخستن", "مۆڵەت", "بەرپرسیاری", "هەق", "بەرنامە", "سزا",
         "دەستوور", "پارلمان", "حکومەت", "رەک"],
        ["ماف", "ئوبووری", "دیاری", "هلبژاردن", "داتا", "ئەنجام"],
    ),
    "literature": (
        ["ئەدبیات", "چیرۆک", "شاعیر", "ئامانج", "رومان", "دیوان", "قیسە", "نووسین", "شاعر",
         "جور", "واژە", "ڕستە", "گیان", "هست", "رول", "ژیان"],
        ["وەژگەرێن", "خوەندن", "گوڤتار", "بانگ", "ئارامی"],
    ),
    "religion": (
        ["ئین", "مزگەوت", "قرئان", "نوژ", "ڕژوو", "پەغەمەر", "ئیسلام", "مەزەب", "برکەت",
         "تەوبە", "دعا", "دوس"],
        ["پیرۆز", "سڵاو", "قونەه", "خوا", "ئیمان", "کتەب", "حەدیس"],
    ),
    "science": (
        ["زانست", "تەکنەلۆژیا", "تاقیکردنەوە", "کیمیا", "فیزیا", "بایۆلۆژیا", "کۆمپیوتەر",
         "داتا", "سیستەم", "پرۆگرام", "ئەلم", "تاجڕۆب"],
        ["بیرکاری", "ئیستاتیستیک", "پەیپەر", "ریسەرچ", "مۆلت"],
    ),
    "education": (
        ["مەوەرخستن", "قوتابخانە", "خوەندن", "خوەندە", "ماموستا", "قۆتاب", "ئیمتحان", "نمرە",
         "پنل", "قنوغ"],
        ["نوە", "کون", "بالا", "ژمان", "زمان", "رەیدی", "ئینگلیزی"],
    ),
    "politics": (
        ["سیاسەت", "حزب", "حکومەت", "ناوەڕۆک", "بەرنامە", "هلبژاردن", "پارلمان", "وەزارەت",
         "سەرۆک", "دیموکراسی", "ئازادی", "جیهانی", "تەجەرە"],
        ["گڤتوگ", "کار", "باسڕگانی", "کۆمەلایەتی", "داتا"],
    ),
}
