"""Fixed values.

Every list and pattern in this module is a value that must equal the one the
original pipeline uses, so that results agree (chemical symbols and names,
the number/unit split list, punctuation, phrase connector words, phrase
exclusions, defaults). They are written out as text in their natural order.
Where a pattern is adapted to the Java regex dialect, the adaptation is noted
next to it.
"""

# ---------------------------------------------------------------- FIXED VALUES
# Chemical element symbols, in atomic-number order (the last entry is the
# placeholder symbol for element 119, used only as a token, never as a real
# element in a formula).
ELEMENTS = [
    "H", "He", "Li", "Be", "B", "C", "N", "O", "F", "Ne", "Na", "Mg", "Al", "Si", "P", "S", "Cl", "Ar", "K",
    "Ca", "Sc", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu", "Zn", "Ga", "Ge", "As", "Se", "Br", "Kr",
    "Rb", "Sr", "Y", "Zr", "Nb", "Mo", "Tc", "Ru", "Rh", "Pd", "Ag", "Cd", "In", "Sn", "Sb", "Te", "I",
    "Xe", "Cs", "Ba", "La", "Ce", "Pr", "Nd", "Pm", "Sm", "Eu", "Gd", "Tb", "Dy", "Ho", "Er", "Tm", "Yb",
    "Lu", "Hf", "Ta", "W", "Re", "Os", "Ir", "Pt", "Au", "Hg", "Tl", "Pb", "Bi", "Po", "At", "Rn", "Fr",
    "Ra", "Ac", "Th", "Pa", "U", "Np", "Pu", "Am", "Cm", "Bk", "Cf", "Es", "Fm", "Md", "No", "Lr", "Rf",
    "Db", "Sg", "Bh", "Hs", "Mt", "Ds", "Rg", "Cn", "Nh", "Fl", "Mc", "Lv", "Ts", "Og", "Uue",
]

# Element names, same order as ELEMENTS.
ELEMENT_NAMES = [
    "hydrogen", "helium", "lithium", "beryllium", "boron", "carbon", "nitrogen", "oxygen", "fluorine",
    "neon", "sodium", "magnesium", "aluminium", "silicon", "phosphorus", "sulfur", "chlorine", "argon",
    "potassium", "calcium", "scandium", "titanium", "vanadium", "chromium", "manganese", "iron",
    "cobalt", "nickel", "copper", "zinc", "gallium", "germanium", "arsenic", "selenium", "bromine",
    "krypton", "rubidium", "strontium", "yttrium", "zirconium", "niobium", "molybdenum", "technetium",
    "ruthenium", "rhodium", "palladium", "silver", "cadmium", "indium", "tin", "antimony", "tellurium",
    "iodine", "xenon", "cesium", "barium", "lanthanum", "cerium", "praseodymium", "neodymium",
    "promethium", "samarium", "europium", "gadolinium", "terbium", "dysprosium", "holmium", "erbium",
    "thulium", "ytterbium", "lutetium", "hafnium", "tantalum", "tungsten", "rhenium", "osmium",
    "iridium", "platinum", "gold", "mercury", "thallium", "lead", "bismuth", "polonium", "astatine",
    "radon", "francium", "radium", "actinium", "thorium", "protactinium", "uranium", "neptunium",
    "plutonium", "americium", "curium", "berkelium", "californium", "einsteinium", "fermium",
    "mendelevium", "nobelium", "lawrencium", "rutherfordium", "dubnium", "seaborgium", "bohrium",
    "hassium", "meitnerium", "darmstadtium", "roentgenium", "copernicium", "nihonium", "flerovium",
    "moscovium", "livermorium", "tennessine", "oganesson", "ununennium",
]

# Units split from a leading number ("5V" -> "5", "V"), in the original order
# (duplicates kept as written).
SPLIT_UNITS = [
    "K", "h", "V", "wt", "wt.", "MHz", "kHz", "GHz", "Hz", "days", "weeks",
    "hours", "minutes", "seconds", "T", "MPa", "GPa", "at.", "mol.",
    "at", "m", "N", "s-1", "vol.", "vol", "eV", "A", "atm", "bar",
    "kOe", "Oe", "h.", "mWcm−2", "keV", "MeV", "meV", "day", "week", "hour",
    "minute", "month", "months", "year", "cycles", "years", "fs", "ns",
    "ps", "rpm", "g", "mg", "mAcm−2", "mA", "mK", "mT", "s-1", "dB",
    "Ag-1", "mAg-1", "mAg−1", "mAg", "mAh", "mAhg−1", "m-2", "mJ", "kJ",
    "m2g−1", "THz", "KHz", "kJmol−1", "Torr", "gL-1", "Vcm−1", "mVs−1",
    "J", "GJ", "mTorr", "bar", "cm2", "mbar", "kbar", "mmol", "mol", "molL−1",
    "MΩ", "Ω", "kΩ", "mΩ", "mgL−1", "moldm−3", "m2", "m3", "cm-1", "cm",
    "Scm−1", "Acm−1", "eV−1cm−2", "cm-2", "sccm", "cm−2eV−1", "cm−3eV−1",
    "kA", "s−1", "emu", "L", "cmHz1", "gmol−1", "kVcm−1", "MPam1",
    "cm2V−1s−1", "Acm−2", "cm−2s−1", "MV", "ionscm−2", "Jcm−2", "ncm−2",
    "Jcm−2", "Wcm−2", "GWcm−2", "Acm−2K−2", "gcm−3", "cm3g−1", "mgl−1",
    "mgml−1", "mgcm−2", "mΩcm", "cm−2s−1", "cm−2", "ions", "moll−1",
    "nmol", "psi", "mol·L−1", "Jkg−1K−1", "km", "Wm−2", "mass", "mmHg",
    "mmmin−1", "GeV", "m−2", "m−2s−1", "Kmin−1", "gL−1", "ng", "hr", "w",
    "mN", "kN", "Mrad", "rad", "arcsec", "Ag−1", "dpa", "cdm−2",
    "cd", "mcd", "mHz", "m−3", "ppm", "phr", "mL", "ML", "mlmin−1", "MWm−2",
    "Wm−1K−1", "Wm−1K−1", "kWh", "Wkg−1", "Jm−3", "m-3", "gl−1", "A−1",
    "Ks−1", "mgdm−3", "mms−1", "ks", "appm", "ºC", "HV", "kDa", "Da", "kG",
    "kGy", "MGy", "Gy", "mGy", "Gbps", "μB", "μL", "μF", "nF", "pF", "mF",
    "A", "Å", "A˚", "μgL−1",
]

# Punctuation tokens: ASCII punctuation followed by the extra symbols.
PUNCT = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + ["\"", "“", "”", "≥", "≤", "×"]

# Diatomic gases accepted as formulas although they hold one element.
DIATOMIC = ["O2", "N2", "Cl2", "F2", "H2"]

# Number replacement token.
NUM_TOKEN = "<nUm>"

# Phrase connector words (may sit between the two words of a phrase).
# The byte-string entries of the original are the en dash, "'s" and "’s".
COMMON_TERMS = ["-", "-", "–", "'s", "’s", "from", "as",
                "at", "by", "of", "on", "into", "to", "than", "over", "in", "the",
                "a", "an", "/", "under", ":"]

# A phrase is dropped when one of its components is, or has as an
# underscore-delimited piece, one of these.
EXCLUDE_PUNCT = ["=", ".", ",", "(", ")", "<", ">", "'", "“", "”", "≥", "≤", "<nUm>"]

# Phrase defaults and embedding training settings.
PHRASE_DEPTH = 2
PHRASE_MIN_COUNT = 10
PHRASE_THRESHOLD = 15.0
W2V_WINDOW = 8
W2V_MIN_COUNT = 5
W2V_EPOCHS = 30
W2V_DIMS = 100

# Classifier defaults.
TRAIN_SHARE = 0.8
SPLIT_SEED = 5
FLUSH_SIZE = 20000
GENERAL_TAG = "general"

# Paragraph marker inside S2ORC abstracts.
PARAGRAPH_MARKER = "::: "

# Clean-corpus text sink record separator.
CORPUS_RECORD_SEP = "\n+++\n"

# Patterns (Java dialect). Number: commas are removed first. The original
# possessive "\)?+" is written "\)?", which is equivalent before "$".
NUMBER_RE = r"^[+-]?\d*\.?\d+\(?\d*\)?$"
# Number followed by a unit-like tail; "\p{script=Latin}" becomes "\p{IsLatin}"
# and the stray "|" of the original character class is dropped.
NUMBER_UNIT_RE = r"(?s)^([+-]?\d*\.?\d+\(?\d*\)?+)([\p{IsLatin}Ωμ]+.*)"
# Valence information: such a token is never a simple formula.
VALENCE_INFO_RE = r"(II+|^IV$|^VI$|\(IV\)|\(V?I{0,3}\))"
# Oxidation state in parentheses after an element symbol or name. The
# original class "[IV|iv]" is fixed to the intended numerals.
VALENCE_SUFFIX_RE = r"(\((?:IV|iv|[Vv]?[Ii]{1,3}|[Vv])\))"
# The original suffix, kept for compatibility mode.
VALENCE_SUFFIX_COMPAT_RE = r"(\(([IV|iv]|[Vv]?[Ii]{0,3})\))"
# Crystal direction in parentheses after an element: Si(111).
DIRECTION_SUFFIX_RE = r"(\(\d\d\d\d?\))"
# ------------------------------------------------------------ END FIXED VALUES

# Real elements (usable in a formula): all symbols but the placeholder.
REAL_ELEMENTS = ELEMENTS[:-1]
ELEMENT_NAME_TO_SYMBOL = dict(zip(ELEMENT_NAMES, ELEMENTS))
ELEMENTS_AND_NAMES = ELEMENTS + ELEMENT_NAMES + [n.capitalize() for n in ELEMENT_NAMES]
UNIT_SET = sorted(set(SPLIT_UNITS))
COMMON_SET = sorted(set(COMMON_TERMS))

# Example British -> American spelling pairs, applied in this order (the
# original ships no dictionary; this list is the default parameter).
SPELLING_GB_US = [
    ("colour", "color"), ("flavour", "flavor"), ("behaviour", "behavior"), ("centre", "center"),
    ("fibre", "fiber"), ("metre", "meter"), ("analyse", "analyze"), ("catalyse", "catalyze"),
    ("ageing", "aging"), ("sulphur", "sulfur"), ("aluminium", "aluminum"), ("haemoglobin", "hemoglobin"),
    ("oestrogen", "estrogen"), ("modelling", "modeling"), ("labelled", "labeled"), ("grey", "gray"),
    ("programme", "program"), ("defence", "defense"), ("licence", "license"), ("organis", "organiz"),
]

# The English stop-word list of Spark ML's StopWordsRemover.
STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll
we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split())
