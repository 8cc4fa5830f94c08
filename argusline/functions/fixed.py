"""Fixed values of the inspection rules."""

# The defect categories, the aliases of misread names in the
# order in which they are tried, and the engines each category calls for.
CATEGORIES = ("Bridge", "Dust", "Little Solder", "Missing", "Much Adhesive", "No solder", "Reverse", "Shifted", "Up Side Down")
ALIASES = (
    ("MUSING", "Missing"),
    ("MISSMG", "Missing"),
    ("SHUFTED", "Shifted"),
    ("STFTED", "Shifted"),
    ("STUFTED", "Shifted"),
    ("SIFTED", "Shifted"),
    ("SH1FTED", "Shifted"),
    ("UP SIDE DOAN", "Up Side Down"),
    ("UP SIDE DOWM", "Up Side Down"),
)
ROUTES = {
    "Shifted": ("shift", "knn"),
    "Up Side Down": ("silk", "semantic", "knn"),
    "Reverse": ("silk", "semantic", "knn"),
    "Missing": ("semantic", "ssim", "silk", "knn"),
    "Bridge": ("ssim", "knn"),
    "Little Solder": ("ssim", "knn"),
    "No solder": ("ssim", "knn"),
    "Dust": ("silk", "knn"),
    "Much Adhesive": ("ssim", "knn"),
}
DEFAULT_ROUTE = ("shift", "silk", "ssim", "semantic", "knn")
#: Categories whose memory is never widened to other categories.
STRICT = ("SHIFTED", "UPSIDEDOWN", "REVERSE")
#: Wordings of categories of several words.
WORDINGS = {
    "Up Side Down": "up.{0,3}side.{0,3}dow[nm]",
    "Little Solder": "little.{0,3}solder",
    "Much Adhesive": "much.{0,3}adhesive",
    "No solder": "no.{0,3}solder",
}
# How recognised panel text, with its usual misreadings, is
# parsed; the first capture of a line is the board, the parts or the value.
PANEL = {
    "board": r"[BbRr8Hh][Oo0][Aa][Rr][Dd]\s*[:\-\.\s]\s*(\S.*)",
    "parts": r"[PpFf][Aa][Rr][Tt][Ss]?\s*[:\-\.\s]\s*(.+?)(?:\s+[Bb][Ll][Oo][Cc][Kk]|\s+[Vv][Aa][Ll]|\s*$)",
    "value": r"[Vv][Aa][Ll1iI][Uu][Ee]\s*[:\-\.\s]\s*(.+?)(?:\s+[Bb][Ll][Oo][Cc][Kk]|\s+[Pp][Aa][Rr]|\s*$)",
}
CUTOFF = 0.45
SHIFT_WORDS = ("SHIFT", "SIFT")
REVERSE_WORDS = ("REVERS", "WRONG")
# Fixed values: (usual, on shift words) tolerance of each engine and its older preset.
TOLERANCES = {"shift": (0.08, 0.04), "silk": (0.05, 0.10), "shift_gate": (0.08, 0.04), "silk_gate": (0.03, 0.08)}
