"""Fixed values.

Word lists, lookup sets, patterns and limits that results depend on.  They are
data, not logic: change them and the answers change.
"""

# Query parameters that only track the visitor (link-graph identity).
TRACKING_LINK = r"(?i)^(utm_|gclid$|fbclid$|mc_|ref$|ref_src$|_ga$)"
# Query parameters that only track the visitor (state identity).
TRACKING_STATE = r"(?i)^(utm_.*|mc_.*|gclid|fbclid|_ga|igshid|ref|ref_src|yclid|msclkid)$"

# Schemes that never lead to a page.
SKIP_HREF = r"(?i)^(mailto:|tel:|javascript:|data:|blob:|#|sms:|ftp:)"

# File extensions that make an href a download.
DOWNLOAD_EXTENSIONS = (
    "pdf", "csv", "tsv", "xls", "xlsx", "doc", "docx", "ppt", "pptx",
    "zip", "gz", "tar", "rar", "7z", "json", "xml", "txt", "rtf", "ods",
    "odt", "odp", "png", "jpg", "jpeg", "svg", "ics", "vcf", "epub", "mp3",
    "mp4", "wav", "mov", "bin", "dmg", "exe", "apk", "parquet", "sql",
)

# Control labels that change or destroy state.
DESTRUCTIVE = (
    r"(?iu)\b(log\s*out|sign\s*out|logout|signout|delete|remove|destroy|trash|"
    r"pay|checkout|buy|purchase|order|subscribe|unsubscribe|deactivate|"
    r"disable|reset|wipe|clear|withdraw|transfer|send|submit|confirm|"
    r"approve|reject|publish|deploy|merge|archive|cancel|terminate)\b"
)
# Control labels that create or modify data.
WRITE = (
    r"(?iu)\b(create|add|new|save|edit|update|upload|import|invite|generate|"
    r"duplicate|copy|rename|move|assign|enable|activate|send|share|export|"
    r"download|run|start|launch|apply)\b|^\+$|^＋$"
)
# Control labels that fetch a file.
DOWNLOAD_LABEL = (
    r"(?iu)\b(download|export|télécharger|telecharger|descargar|exportar)\b|下载|導出|导出"
)
# Control labels never followed while exploring.
SKIP_NAV = (
    r"(?iu)\b(create|add|new|save|delete|remove|destroy|submit|confirm|pay|checkout|buy|"
    r"upload|import|invite|generate|duplicate|publish|deploy|archive|cancel|"
    r"log\s*out|sign\s*out|logout|crear|nuevo|nueva|a[nñ]adir|agregar|guardar|"
    r"eliminar|borrar|enviar|subir)\b"
)

# Verbs of create triggers, and of terminal actions.
CREATE_VERBS = (
    "create", "add", "new", "start", "crear", "nuevo", "nueva", "añadir", "anadir",
    "agregar", "generar",
)
ACTION_VERBS = ("download", "export", "descargar", "exportar")
GOAL_VERBS = CREATE_VERBS + ACTION_VERBS

# Tokens of a goal that never select a trigger.
GOAL_STOPWORDS = (
    "a", "an", "the", "to", "of", "for", "in", "on", "at", "by", "with", "and",
    "or", "my", "me", "i", "do", "how", "some", "this", "that",
    "create", "add", "new", "make", "start", "generate",
    "crear", "nuevo", "nueva", "añadir", "anadir", "agregar", "generar",
    "download", "export", "descargar", "exportar",
    "un", "una", "el", "la", "los", "las", "de", "para",
)
# Words skipped when a goal marks cached triggers as stale.
STALE_STOPWORDS = ("a", "the", "create", "add", "new", "make", "to")
# Words skipped when labels are suggested.
SUGGEST_STOPWORDS = ("the", "a", "an", "and", "for", "new", "add", "all", "any", "with", "from")

FALSY_WORDS = ("", "0", "false", "no", "off", "none", "null", "unchecked")

# Container and role sets of the page extractors.
NAV_ROLES = ("tab", "menuitem", "menuitemradio", "menuitemcheckbox")
NAV_CONTAINER_ROLES = ("tablist", "menu", "menubar", "navigation")
NAV_CONTAINER_TAGS = ("nav", "aside", "header")
CONTROL_BULK_ROLES = ("grid", "row", "gridcell", "option")
CONTROL_BULK_TAGS = ("table", "tbody", "thead", "tr", "td", "th")
ACTION_BULK_ROLES = (
    "grid", "table", "row", "rowgroup", "gridcell", "cell", "columnheader", "listbox", "option",
)
ACTION_BULK_TAGS = ("table", "tbody", "thead", "tr", "td", "th")
COLLECTION_ROLES = ("grid", "table", "treegrid", "tree", "list", "listbox", "feed")
ITEM_ROLES = ("row", "treeitem", "listitem", "option", "article")
ITEM_TAGS = ("tr", "li")
SIBLING_PARENT_TAGS = ("div", "ul", "ol", "tbody", "section", "nav", "main")

# Ids minted anew by a framework at every render.
GENERATED_ID = r"(?i)^(radix|headlessui|react-aria|reach-|mui|chakra|rc[-_])"

# Form fields and buttons.
FORM_NOISE = r"(?i)ask me anything|search\.\.\.|^search$|type a message|chat"
FORM_SAVE = (
    r"(?i)save|create|add|submit|confirm|next|finish|crear|guardar|a[nñ]adir|agregar|"
    r"siguiente|continuar"
)
FIELD_ROLES = ("combobox", "listbox", "switch", "checkbox", "radio", "radiogroup")
NON_FIELD_TYPES = ("hidden", "submit", "button", "image")
NON_BEARING_TYPES = ("hidden", "submit", "button", "image", "reset", "search")
CHECK_TYPES = ("checkbox", "radio", "toggle", "switch")
SELECT_TYPES = ("select", "dropdown", "radiogroup", "listbox", "combobox")

# Pagination controls.
NEXT_TEXT = r"(?iu)^(next|next page|suivant|siguiente|weiter|próxima|proxima|›|»|→|>|>>)$"
NEXT_LABEL = r"(?iu)\b(next|suivant|siguiente|weiter|próxim|proxim)\b"

# Limits.
LINK_TEXT = 90
CONTROL_TEXT = 60
QUERY_TEXT = 120
CONTROLS_PER_PAGE = 150
QUERY_LIMIT = 200
ACTIONS_PER_STATE = 25
ITEM_TEXT = 140
ITEMS_PER_COLLECTION = 500
CELLS_PER_ITEM = 10
ARIA_COLLECTIONS_PER_PAGE = 60
COLLECTIONS_PER_PAGE = 80
SIBLINGS_MIN = 5
FORM_OPTIONS = 25
FORM_SUBMITS = 6
PAGE_SIG_ITEMS = 40
CONTENT_LIMIT = 40
MAX_PATH_LEN = 5
MAX_PATHS = 50
MAX_STATES = 500
MAX_VISITS = 1200
MAX_DEPTH = 5
MAX_PER_SECTION = 2
ROWS_PER_LIST = 1
DATA_LIST_MIN = 3
MAX_CROSS_HOST = 25
TRANSCRIPT_ENTRIES = 500
RUN_LOG_ENTRIES = 2000
RUNS_PER_FLOW = 50
USER_TURNS = 100
TITLE_CHARS = 60
LOG_CHARS = 500
WIRE_TEXT_CHARS = 20000
TRUNCATION_MARK = "…[truncated]"
UNREACHABLE = 1000000
HUB_FLOOR = 8
HUB_SHARE = 0.4
DETECT_MIN_CONTROLS = 8
DETECT_MAX_PROBES = 3
MAX_SUGGESTIONS = 5
SUGGEST_CUTOFF = 0.6
