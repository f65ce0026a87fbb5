"""Taxonomies, keyword lexicons, repair rules and word lists.

These lists define the labels; order matters, because the first criterion with a
keyword inside the text wins and taxonomy order is report order.
"""

FALLBACK = "Global_experience"
FALLBACK_FR = "Expérience globale"

SHARED_TAXONOMY = [
    "Food_quality", "Presentation", "Ambience", "Service", "Speed", "Price_value",
    "Cleanliness_hygiene", "Product_quality", "Availability", "Information",
    "Care_quality", "Global_experience",
]

ENGLISH_TAXONOMY = ["Price", "Delay", "Cleanliness", "Quality", "Service", "Global_experience"]

EVALUATION_TAXONOMY = [*SHARED_TAXONOMY, "Delay", "Price", "Quality"]

STRICT_TAXONOMY_FR = [
    "Qualité des plats", "Présentation", "Service", "Ambiance / cadre",
    "Rapport qualité-prix", "Goût", "Rapidité du service", "Propreté", "Accueil",
    "Qualité des boissons", "Qualité des produits", "Prix", "Choix / disponibilité",
    "Service client", "Disponibilité des produits", "Rapidité en caisse",
    "Qualité des soins", "Compétence du personnel", "Hygiène", "Accueil / écoute",
    "Délais", "Disponibilité médicaments", "Conseil / accompagnement",
    "Qualité de la réparation", "Fiabilité / honnêteté", "Respect des délais",
    "Qualité du service", "Clarté des informations", "Rapidité de traitement",
    "Expérience globale",
]

FRENCH_LEXICON = {
    "Food_quality": [
        "qualité des plats", "plat", "plats", "nourriture", "repas", "goût", "délicieux",
        "dégueulasse", "bon", "mauvais", "qualité des boissons", "boisson", "boissons",
        "food", "meal", "taste", "drink", "drinks",
    ],
    "Presentation": ["présentation", "dressage", "look", "presentation"],
    "Ambience": [
        "ambiance", "ambiance / cadre", "cadre", "décor", "musique", "bruyant", "calme",
        "atmosphère", "atmosphere", "music", "noise", "noisy",
    ],
    "Service": [
        "service", "serveur", "serveuse", "serveurs", "serveuses", "personnel", "staff",
        "accueil", "accueil / écoute", "qualité du service", "service client", "polite",
        "rude", "friendly", "customer service",
    ],
    "Speed": [
        "rapidité du service", "service rapide", "service lent", "délai", "délais",
        "retard", "attente", "attendu", "long", "lent", "rapide", "vitesse",
        "rapidité en caisse", "rapidité de traitement", "wait", "waiting", "delay",
        "late", "fast", "slow",
    ],
    "Price_value": [
        "prix", "trop cher", "pas cher", "cher", "bon marché", "rapport qualité-prix",
        "coût", "facture", "expensive", "cheap", "price", "cost", "value",
    ],
    "Cleanliness_hygiene": [
        "propreté", "propre", "sale", "saleté", "hygiene", "hygiène", "odeur", "odeurs",
        "poussière", "toilettes", "clean", "dirty", "hygiene", "smell", "odor",
    ],
    "Product_quality": [
        "qualité des produits", "produit", "produits", "qualité de la réparation",
        "réparation", "fiabilité", "honnêteté", "product quality", "reliability",
    ],
    "Availability": [
        "choix", "disponibilité", "disponibilité des produits",
        "disponibilité médicaments", "rupture de stock", "stock", "availability",
        "out of stock",
    ],
    "Information": [
        "clarté des informations", "information", "informations", "explications",
        "communication", "conseil", "accompagnement", "information clarity", "advice",
        "support",
    ],
    "Care_quality": [
        "qualité des soins", "soins", "médecin", "docteur", "compétence du personnel",
        "compétent", "incompétent", "care quality", "doctor", "nurse", "staff competence",
    ],
    "Global_experience": ["expérience globale", "global", "expérience générale"],
}

ENGLISH_LEXICON = {
    "Price": [
        "expensive", "cheap", "price", "cost", "value", "worth", "overpriced", "budget",
        "fee", "charges",
    ],
    "Delay": [
        "late", "delay", "delayed", "slow", "waiting", "waited", "time", "hours",
        "minutes", "delivery time", "response time",
    ],
    "Cleanliness": [
        "clean", "dirty", "hygiene", "smell", "odor", "stains", "messy", "dusty", "filthy",
    ],
    "Quality": [
        "quality", "broken", "faulty", "damaged", "working", "excellent", "good", "bad",
        "taste", "fresh", "stale",
    ],
    "Service": [
        "service", "staff", "support", "rude", "helpful", "customer care", "agent",
        "representative", "employee",
    ],
}

ARABIZI_LEXICON = {
    "Food_quality": [
        "bnina", "mekla", "tayra", "hayla", "abann", "skhouna", "mouch tayba", "dwa",
        "bnn", "banni",
    ],
    "Ambience": [
        "ambiance", "jawou", "jaw", "music", "muzika", "ghneya", "sout", "bruit",
        "bruyant", "calm", "calme",
    ],
    "Service": [
        "khidma", "m3allem", "m3alem", "metrabya", "yadh7ek", "isti9bal", "accueil",
        "staff", "personnel", "pro", "service", "agent",
    ],
    "Speed": [
        "rzin", "rzina", "fisa3", "fissa3", "nestana", "nesta", "stanna", "yabta",
        "ta3til", "wa9t", "sa3at", "d9ayeq", "masta3jel", "mesta3jel", "slow", "rapid",
        " rapide",
    ],
    "Price_value": [
        "ghali", "ghlya", "r5is", "r5isa", "soum", "aswam", "flous", "5allas",
        "mouch blech", "bi9adeh", "soumou", "prix", "cher", "tres cher", "pas cher",
    ],
    "Cleanliness_hygiene": [
        "ndhifa", "ndhif", "ndhaf", "mamsou5a", "moussekha", "wsakh", "wsah", "ghobra",
        "5anza", "ri7a", "rwaye7", "sale", "propre",
    ],
    "Product_quality": ["sla3", "produit", "produits", "khal", "t9sir"],
    "Availability": ["disponible", "dispo", "ma fama ch", "ma fama7ch", "mawjoud", "stock"],
    "Information": ["ma5barounich", "ma fihach info", "information", "explication"],
    "Care_quality": ["docteur", "tabib", "soin", "soins", "hospital", "spital"],
    "Global_experience": ["bahi", "mezyen", "haya", "bravo", "nice", "amazing"],
}

OLD_FRENCH_LEXICON = {
    "Prix": [
        "cher", "prix", "argent", "payé", "coût", "facture", "budget", "euros", "dt",
        "millimes",
    ],
    "Délais": [
        "attendu", "long", "retard", "heures", "minutes", "lent", "rapide", "délais",
        "attente",
    ],
    "Propreté": [
        "sale", "propre", "hygiène", "odeur", "poussière", "toilettes", "ndhifa",
        "moussekha",
    ],
    "Qualité des plats": [
        "goût", "délicieux", "froid", "cuisson", "saveur", "manger", "pizza", "burger",
        "bnina", "mekla",
    ],
}

REPAIR_GROUPS = {
    "Prix": ["prix", "cher", "tarif", "argent", "coût", "facture", "frais"],
    "Service": ["service", "serveur", "personnel", "accueil", "staff"],
    "Qualité des plats": [
        "plat", "goût", "cuisine", "mekla", "délicieux", "manger", "boisson", "café",
    ],
    "Hygiène": ["hygiène", "propreté", "sale", "propre", "nettoyage", "toilettes"],
    "Délais": ["délais", "attente", "rapide", "lent", "retard", "heures", "minutes"],
    "Santé": ["soin", "médicament", "clinique", "docteur", "pharmacie"],
    "WiFi": ["wifi", "connexion", "internet"],
    "Réparation": ["réparation", "garage", "moteur", "panne"],
}

REPAIR_GLOBAL = ["global", "expérience"]

GHOST_LABELS = ["- Sentiment", "Criterion", "Sentiment", "Category", "---"]

LABEL_FIXES = {"Retail: Rapidité En Caisse": "Rapidité en caisse"}

PREDICTION_ALIASES = {
    "Service_quality": "Service",
    "Food": "Food_quality",
    "Hygiene": "Cleanliness_hygiene",
    "Global": "Global_experience",
}

ABUSIVE_WORDS = [
    "fuck", "fucking", "shit", "bitch", "bastard", "merde", "con", "putain", "zebb",
    "zebi", "khra", "5ra", "mibouna", "mibouna", "mibouni", "mibounou", "mibounouh", "rab",
]

LANGUAGES = [
    "French", "Tunisian Derja (Arabic script)", "Tunisian Arabizi (Latin script + 3,7,9)",
    "English",
]

# Words that tabular readers take as a missing cell.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
