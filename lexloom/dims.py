"""Fixed dimension values used by the operators.

Everything here is plain data whose values decide results (names, ids, word
lists, weights, patterns); the logic that uses it lives elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.runtime import values_table

# Short code name -> official text id.
CODE_TEXT_IDS = {
    "CC": "LEGITEXT000006070721",
    "CP": "LEGITEXT000006070719",
    "CPC": "LEGITEXT000006070716",
    "CPP": "LEGITEXT000006071154",
    "CT": "LEGITEXT000006072050",
    "CSP": "LEGITEXT000006072665",
    "CJA": "LEGITEXT000006070933",
    "CGCT": "LEGITEXT000006070633",
    "CCom2": "LEGITEXT000006070162",
    "CRPA": "LEGITEXT000031366350",
    "CPI": "LEGITEXT000006069414",
    "CASF": "LEGITEXT000006074069",
    "CMF": "LEGITEXT000006072026",
    "C.com": "LEGITEXT000005634379",
    "C.cons": "LEGITEXT000006069565",
    "C.éduc": "LEGITEXT000006071191",
    "CU": "LEGITEXT000006074075",
    "C.env": "LEGITEXT000006074220",
    "CR": "LEGITEXT000006071367",
    "CGI": "LEGITEXT000006069577",
    "CESEDA": "LEGITEXT000006070158",
    "CSS": "LEGITEXT000006073189",
    "CCH": "LEGITEXT000006074096",
    "CTransp": "LEGITEXT000023086525",
    "CAss": "LEGITEXT000006073984",
    "CDef": "LEGITEXT000006071307",
    "CSI": "LEGITEXT000025503132",
    "CEner": "LEGITEXT000023983208",
    "CCiné": "LEGITEXT000020908868",
    "CSport": "LEGITEXT000006071318",
    "CJF": "LEGITEXT000006070249",
    "COJ": "LEGITEXT000006071164",
    "CPCE": "LEGITEXT000006070987",
    "CElec": "LEGITEXT000006070239",
    "CGFP": "LEGITEXT000044416551",
    "LPF": "LEGITEXT000006069583",
    "CRoute": "LEGITEXT000006074228",
    "CPatr": "LEGITEXT000006074236",
    "CMut": "LEGITEXT000006074067",
    "CPénit": "LEGITEXT000045476241",
    "CCP": "LEGITEXT000037701019",
    "CAvCiv": "LEGITEXT000006074234",
    "CIBS": "LEGITEXT000044595989",
    "CDouanes": "LEGITEXT000006071570",
    "CForêt": "LEGITEXT000025244092",
    "CG3P": "LEGITEXT000006070299",
    "CTou": "LEGITEXT000006074073",
    "CSN": "LEGITEXT000006071335",
    "CRech": "LEGITEXT000006071190",
    "CPortM": "LEGITEXT000006074233",
    "CDE": "LEGITEXT000006070208",
    "CMin": "LEGITEXT000023501962",
    "CJM": "LEGITEXT000006071360",
    "CExpr": "LEGITEXT000006074224",
    "CVoir": "LEGITEXT000006070667",
    "CJPM": "LEGITEXT000039086952",
    "CArt": "LEGITEXT000006075116",
    "CPCMR": "LEGITEXT000006070302",
    "CPCEx": "LEGITEXT000025024948",
    "CGIANII": "LEGITEXT000006069569",
    "CGIANI": "LEGITEXT000006069568",
    "CGIANIII": "LEGITEXT000006069574",
    "CGIANIV": "LEGITEXT000006069576",
    "CRurA": "LEGITEXT000006071366",
    "CCNC": "LEGITEXT000006070300",
    "CMinA": "LEGITEXT000006071785",
    "CFAS": "LEGITEXT000006072637",
    "CDouMay": "LEGITEXT000006071645",
    "CDPFNav": "LEGITEXT000006074237",
    "CTravM": "LEGITEXT000006072051",
    "CDPMM": "LEGITEXT000006071188",
    "CPRM": "LEGITEXT000006074066",
    "CDEMay": "LEGITEXT000006074235",
    "CIMM": "LEGITEXT000006070666",
    "CDA": "LEGITEXT000006074232",
    "CONST": "JORFTEXT000000571356",
    "LIL": "JORFTEXT000000886460",
    "LO58": "JORFTEXT000000705065",
    "L2005-102": "JORFTEXT000000809647",
}

# Administrative court code -> court name.
ADMIN_COURTS = {
    "CE": "Conseil d'État",
    "CE-CAA": "Conseil d'État + cours administratives d'appel (jurisprudence citée)",
    "CAA13": "Cour administrative d'appel de Marseille",
    "CAA31": "Cour administrative d'appel de Toulouse",
    "CAA33": "Cour administrative d'appel de Bordeaux",
    "CAA44": "Cour administrative d'appel de Nantes",
    "CAA54": "Cour administrative d'appel de Nancy",
    "CAA59": "Cour administrative d'appel de Douai",
    "CAA69": "Cour administrative d'appel de Lyon",
    "CAA75": "Cour administrative d'appel de Paris",
    "CAA78": "Cour administrative d'appel de Versailles",
    "TA06": "Tribunal Administratif de Nice",
    "TA13": "Tribunal Administratif de Marseille",
    "TA14": "Tribunal Administratif de Caen",
    "TA20": "Tribunal Administratif de Bastia",
    "TA21": "Tribunal Administratif de Dijon",
    "TA25": "Tribunal Administratif de Besançon",
    "TA30": "Tribunal Administratif de Nîmes",
    "TA31": "Tribunal Administratif de Toulouse",
    "TA33": "Tribunal Administratif de Bordeaux",
    "TA34": "Tribunal Administratif de Montpellier",
    "TA35": "Tribunal Administratif de Rennes",
    "TA38": "Tribunal Administratif de Grenoble",
    "TA44": "Tribunal Administratif de Nantes",
    "TA45": "Tribunal Administratif d'Orléans",
    "TA51": "Tribunal Administratif de Châlons-en-Champagne",
    "TA54": "Tribunal Administratif de Nancy",
    "TA59": "Tribunal Administratif de Lille",
    "TA63": "Tribunal Administratif de Clermont-Ferrand",
    "TA64": "Tribunal Administratif de Pau",
    "TA67": "Tribunal Administratif de Strasbourg",
    "TA69": "Tribunal Administratif de Lyon",
    "TA75": "Tribunal Administratif de Paris",
    "TA76": "Tribunal Administratif de Rouen",
    "TA77": "Tribunal Administratif de Melun",
    "TA78": "Tribunal Administratif de Versailles",
    "TA80": "Tribunal Administratif d'Amiens",
    "TA83": "Tribunal Administratif de Toulon",
    "TA86": "Tribunal Administratif de Poitiers",
    "TA87": "Tribunal Administratif de Limoges",
    "TA93": "Tribunal Administratif de Montreuil",
    "TA95": "Tribunal Administratif de Cergy-Pontoise",
    "TA101": "Tribunal Administratif de La Réunion",
    "TA102": "Tribunal Administratif de la Martinique",
    "TA103": "Tribunal Administratif de la Polynésie française",
    "TA104": "Tribunal Administratif de Nouvelle-Calédonie",
    "TA105": "Tribunal Administratif de la Guadeloupe",
    "TA106": "Tribunal Administratif de la Guyane",
    "TA107": "Tribunal Administratif de Mayotte",
    "TA108": "Tribunal Administratif de St Martin",
    "TA109": "Tribunal Administratif de St Barthélemy",
}

# French month names, in order.
MONTHS = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet",
          "août", "septembre", "octobre", "novembre", "décembre"]

# Months as abbreviated in references (folded) -> month number.
MONTH_ABBREVIATIONS = {
    "janv": "01", "fevr": "02", "fev": "02", "mars": "03", "avr": "04", "mai": "05", "juin": "06",
    "juil": "07", "aout": "08", "sept": "09", "oct": "10", "nov": "11", "dec": "12",
}

# Labels of the federated sources.
SOURCE_LABELS = {"dila": "JUDICIAIRE", "ariane": "CE", "admin": "ADMIN", "cedh": "CEDH", "cjue": "CJUE"}

# Court codes of the judicial collection -> display name.
COURT_LABELS = {
    "cc": "Cour de cassation",
    "ca": "Cour d'appel",
    "cec": "Conseil d'État",
    "constit": "Conseil constitutionnel",
}

# Court type of the court API -> base name.
API_COURTS = {
    "cc": "Cour de cassation",
    "ca": "Cour d'appel",
    "tj": "Tribunal judiciaire",
    "tcom": "Tribunal de commerce",
    "cph": "Conseil de prud'hommes",
}

# Court family filter -> name fragment.
COURT_FAMILIES = {
    "cassation": "Cour de cassation",
    "appel": "Cour d'appel",
    "tj": "Tribunal judiciaire",
    "tcom": "Tribunal de commerce",
    "constit": "Conseil constitutionnel",
}

# Natures of constitutional decisions.
CONSTITUTIONAL_NATURES = ["QPC", "DC", "L", "SEN", "AN", "PDR", "ORGA", "REF", "ELEC", "I"]

# Which query intents each federated source can answer.
SOURCE_CAPABILITIES = {
    "ariane": ["ariane_id", "dossier_admin", "phrase", "fts"],
    "admin": ["dce_id", "dossier_admin", "ariane_id", "pourvoi", "ecli", "phrase", "fts"],
    "dila": ["juritext", "pourvoi", "rg", "ecli", "phrase", "fts"],
    "cedh": ["itemid_hudoc", "ecli", "phrase", "fts"],
    "cjue": ["celex", "ecli", "phrase", "fts"],
}

# Court filter of the federated search -> sources asked.
COURT_DISPATCH = {
    "": ["dila", "ariane", "admin", "cedh", "cjue"],
    "admin": ["ariane", "admin"],
    "ce": ["ariane", "admin"],
    "caa": ["admin"],
    "ta": ["admin"],
    "judic": ["dila"],
    "cass": ["dila"],
    "ca": ["dila"],
    "constit": ["dila"],
    "europ": ["cedh", "cjue"],
    "cedh": ["cedh"],
    "cjue": ["cjue"],
}

# Unambiguous court acronyms -> equivalent names, searched as one OR group.
COURT_ALIASES = {
    "TJ": ["Tribunal judiciaire", "Tribunal de grande instance", "Tribunal d'instance", "TGI", "TI"],
    "TGI": ["Tribunal de grande instance", "Tribunal judiciaire", "TJ"],
    "TI": ["Tribunal d'instance", "Tribunal judiciaire", "TJ"],
    "TASS": ["Tribunal des affaires de sécurité sociale", "pôle social", "Tribunal judiciaire"],
    "CPH": ["Conseil de prud'hommes", "conseil prud'hommes"],
    "CAA": ["Cour administrative d'appel"],
    "CEDH": ["Cour européenne des droits de l'homme", "Cour EDH"],
    "CJUE": ["Cour de justice de l'Union européenne", "Cour de justice de l'Union", "CJCE"],
    "CJCE": ["Cour de justice des Communautés européennes",
             "Cour de justice de l'Union européenne", "CJUE"],
}

# Reference number kind -> sources that can hold it.
NUMBER_ROUTES = {
    "cjue": ["cjue"], "celex": ["cjue"], "cedh": ["cedh"], "caa_ce": ["admin"],
    "dossier": ["admin", "ariane"], "pourvoi": ["dila"], "rg": ["dila"], "tdc": ["admin"],
    "ecli": ["admin", "dila", "cjue"],
}

# Court type named in a reference -> sources.
COURT_SOURCES = {
    "cjue": ["cjue"], "cedh": ["cedh"], "ta": ["admin"], "caa": ["admin"], "ce": ["admin", "ariane"],
    "ca": ["dila"], "cass": ["dila"], "cph": ["dila"], "tj": ["dila"], "tsa": ["dila"],
    "tcom": ["dila"], "tdc": ["admin"],
}

# Folded fragment that the court field of a hit must contain, per court type.
COURT_SIGNATURES = {
    "ta": "tribunal administratif", "caa": "cour administrative", "ce": "conseil",
    "cass": "cassation", "ca": "cour d'appel", "tj": "tribunal judiciaire", "cph": "prud",
    "tcom": "commerce", "tsa": "tribunal superieur", "tdc": "conflits", "cedh": "", "cjue": "",
}

# Id prefixes tried for an administrative docket, per court type ('' = any).
ADMIN_ID_PREFIXES = {
    "ta": ["DTA", "ORTA"],
    "caa": ["DCAA", "ORCA"],
    "ce": ["DCE", "ORCE"],
    "": ["DTA", "DCAA", "DCE", "ORTA", "ORCA", "ORCE"],
}

# Words that never count as a party name.
PARTY_NOISE = ["publie", "publiee", "recueil", "lebon", "bulletin", "tables", "mentionne", "mentionnee",
               "point", "affaire", "decision", "arret", "ordonnance", "jugement"]

# Words caught where a city is expected but that are no city.
CITY_STOPWORDS = ["la", "le", "les", "ce", "cet", "cette", "ladite", "ledit", "dudit", "celle", "celui",
                  "ceans", "ville", "commune", "meme"]

# Search scope -> thesaurus sources.
SCOPE_SOURCES = {
    "admin": ["pcja", "eurovoc", "vie_publique"],
    "judiciaire": ["judilibre_cass", "judilibre_ca", "judilibre_tj", "eurovoc"],
    "europeen": ["eurovoc"],
    "lois": ["vie_publique", "eurovoc", "pcja"],
    "toutes": ["pcja", "eurovoc", "vie_publique", "judilibre_cass", "judilibre_ca", "judilibre_tj"],
}

# Authority weight of each collection in the unified search.
AUTHORITY = {"cjue": 1.20, "cedh": 1.20, "dila": 1.15, "jade": 1.10, "legi": 0.80}
RANK_DECAY = 0.001

# Publication letter of an administrative decision -> collection name.
PUBLICATION_LABELS = {"A": "Recueil Lebon", "B": "Tables Lebon", "C": "Inédit"}

# Pivot types of the local-service dump that belong to the justice system.
JUSTICE_PIVOTS = ["tgi", "ti", "cour_appel", "ta", "caa", "prudhommes", "te", "tribunal_commerce", "tae",
                  "cdad", "mjd", "spip", "ordre_avocats", "vif_tj", "vif_ca", "bav"]

# Display order of directory types; unknown types come last.
DIRECTORY_ORDER = [
    "tgi", "ti", "cour_appel", "ta", "caa", "tribunal_commerce", "tae", "prudhommes", "te", "spip",
    "cdad", "mjd", "ordre_avocats", "vif_tj", "vif_ca", "bav", "point_justice",
    "dacs", "dgccrf", "cabinet_ministeriel", "administration_centrale",
    "prefecture", "sous_pref", "conseil_reg", "conseil_dep", "epci",
    "mairie", "ccas", "police_municipale",
    "france_services", "tresorerie", "cci", "mission_locale", "cij", "cio",
    "clic", "pmi", "mda", "pif", "pcb", "fr_renov", "point_accueil_numerique", "autre",
]

# Two-letter type of a CELEX number -> case letter.
CELEX_CASE_LETTERS = {"CJ": "C", "TJ": "T", "FJ": "F", "CO": "C", "TO": "T", "CC": "C", "CB": "C"}

# Two-letter type of a CELEX number -> ECLI court letter.
CELEX_ECLI_LETTERS = {"CJ": "C", "CO": "C", "CC": "C", "TJ": "T", "TO": "T", "FC": "F"}

# Document types that are full judgments of the human-rights court.
FULL_JUDGMENTS = ["HFJUD", "HEJUD"]

# Language preference when a decision exists in several languages.
LANGUAGE_PRIORITY = ["FRE", "ENG"]

# Rows per enumeration page and volume from which a category gets its own page.
ENUMERATION_PAGE = 50_000



def code_table(spark: SparkSession) -> DataFrame:
    """``code, text_id`` — fixed size, safe to broadcast."""
    return values_table(spark, CODE_TEXT_IDS.items(), "code string, text_id string")



def scope_table(spark: SparkSession) -> DataFrame:
    rows = [(scope, src) for scope, sources in SCOPE_SOURCES.items() for src in sources]
    return values_table(spark, rows, "scope string, source string")

