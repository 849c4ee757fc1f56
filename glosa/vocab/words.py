"""Word lists used by the filters and scorers.

Everything in this module is a FIXED VALUE: results depend on the exact
spelling and order of these lists, so they are stated plainly here and nowhere
else.  Every function that uses one of them takes it as a default argument, so
callers can pass their own list.
"""

# ---------------------------------------------------------------- fixed values
# Geographic phrases and places
GEO_KEYWORDS_BASIC = ["hi from", "love from", "greetings from", "watching from"]

GEO_KEYWORDS = [
    "hi from", "love from", "greetings from", "watching from",
    "sending love from", "greetings to", "hello from",
]

LOCATIONS_BASIC = [
    "India", "Turkey", "USA", "UK", "Canada", "Australia", "Germany", "France", "Brazil",
    "Japan", "China", "Russia", "Italy", "Spain", "Mexico", "Argentina", "Egypt", "Nigeria",
    "Kenya", "Pakistan", "Bangladesh",
]
CITY_SUFFIX_PATTERN = "[A-Za-z]+[Cc]ity"

LOCATIONS_ENHANCED = [
    "India", "Turkey", "USA", "United States", "UK", "United Kingdom", "Canada", "Australia",
    "Germany", "France", "Brazil", "Japan", "China", "Russia", "Italy", "Spain", "Mexico",
    "Argentina", "Egypt", "Nigeria", "Kenya", "Pakistan", "Bangladesh", "Indonesia", "Thailand",
    "Philippines", "Vietnam", "South Korea", "Netherlands", "Sweden", "Norway", "Denmark",
    "Finland", "New York", "Los Angeles", "London", "Paris", "Tokyo", "Beijing", "Mumbai",
    "Delhi", "Istanbul", "Moscow", "Berlin", "Madrid", "Rome", "Sydney", "Toronto", "Montreal",
]
MAJOR_LOCATIONS = ["India", "USA", "UK", "Canada", "Australia", "New York", "London"]

# Flags that have a display name; every other flag is reported as Unknown_<flag>
FLAG_NAMES = {
    "🇺🇸": "United States", "🇮🇳": "India", "🇹🇷": "Turkey", "🇬🇧": "United Kingdom",
    "🇨🇦": "Canada", "🇦🇺": "Australia", "🇩🇪": "Germany", "🇫🇷": "France",
    "🇧🇷": "Brazil", "🇯🇵": "Japan", "🇨🇳": "China", "🇷🇺": "Russia",
}

# Aliases are tried in this order, before any official country name
COUNTRY_ALIASES = [
    ("United States", "United States"), ("USA", "United States"), ("U.S.A", "United States"),
    ("U.S.", "United States"), ("United Kingdom", "United Kingdom"), ("UK", "United Kingdom"),
    ("U.K.", "United Kingdom"), ("England", "United Kingdom"), ("UAE", "United Arab Emirates"),
    ("Bosnia", "Bosnia and Herzegovina"),
]

# Cultural identity
CATEGORIES = ["Ethnic Identity", "Religious Identity", "Collective Memory"]

CULTURAL_BASIC = {
    "Ethnic Identity": ["latino", "hispanic", "asian", "white", "caucasian", "black"],
    "Religious Identity": ["muslim", "islam", "christian", "christ"],
    "Collective Memory": [
        "my country", "our country", "in my culture", "homeland", "diaspora", "immigrant",
    ],
}

CULTURAL_CONFIG = {
    "Ethnic Identity": ["latino", "hispanic", "asian", "white", "caucasian", "black", "african"],
    "Religious Identity": ["muslim", "islam", "christian", "christ", "buddhist", "hindu"],
    "Collective Memory": [
        "my country", "our country", "in my culture", "homeland", "diaspora", "immigrant",
    ],
}

CULTURAL_DIRECT = {
    "Ethnic Identity": [
        "latino", "latina", "hispanic", "asian", "white", "caucasian", "black", "african", "arab",
        "middle eastern", "indigenous", "native american", "european", "south asian", "east asian",
    ],
    "Religious Identity": [
        "muslim", "islam", "islamic", "christian", "christianity", "christ", "buddhist",
        "buddhism", "hindu", "hinduism", "jewish", "judaism", "catholic", "protestant",
        "orthodox", "sikh", "jain",
    ],
    "Collective Memory": [
        "my country", "our country", "our nation", "homeland", "motherland", "fatherland",
        "diaspora", "immigrant", "migration", "exile",
    ],
}

CULTURAL_PATTERNS = {
    "Ethnic Identity": [
        r"i am \w+ heritage", r"my \w+ background", r"half \w+", r"part \w+", r"\w+ descent",
        r"born in \w+", r"from \w+ family",
    ],
    "Religious Identity": [
        r"i pray", r"my faith", r"god bless", r"allah", r"jesus", r"buddha", r"temple",
        r"mosque", r"church", r"synagogue",
    ],
    "Collective Memory": [
        r"in my culture", r"our tradition", r"our people", r"my people",
        r"where i come from", r"back home", r"my ancestors",
    ],
}

# Only the ethnic category has indicator words that add to the score
CULTURAL_INDICATORS = {
    "Ethnic Identity": [
        "ethnicity", "race", "heritage", "ancestry", "roots", "background", "blood", "origin",
        "descent", "lineage",
    ],
    "Religious Identity": [],
    "Collective Memory": [],
}

CONTEXT_BOOSTERS = {
    "Ethnic Identity": ["proud", "identity", "represent", "culture", "tradition"],
    "Religious Identity": ["believe", "faith", "pray", "blessed", "spiritual"],
    "Collective Memory": ["remember", "history", "ancestors", "legacy", "heritage"],
}

# Spanish vocabulary
ES_KEYWORDS = [
    "saludos desde", "amor desde", "viendo desde", "escribiendo desde", "soy de", "vivo en",
    "desde", "aquí en", "mi país", "mi ciudad", "mi cultura", "nosotros los", "somos", "patria",
    "homeland", "raíces",
]
ES_IDENTITY = [
    "latino", "latina", "hispanico", "hispana", "mexicano", "mexicana", "colombiano",
    "colombiana", "argentino", "argentina", "español", "española", "puertorriqueño",
    "puertorriqueña", "dominicano", "dominicana", "venezolano", "venezolana", "peruano",
    "peruana", "chileno", "chilena", "ecuatoriano", "ecuatoriana", "boliviano", "boliviana",
    "paraguayo", "paraguaya", "uruguayo", "uruguaya", "costarricense", "panameño", "panameña",
    "guatemalteco", "guatemalteca", "hondureño", "hondureña", "salvadoreño", "salvadoreña",
    "nicaragüense", "cubano", "cubana",
]
ES_RELIGIOUS = [
    "católico", "católica", "cristiano", "cristiana", "musulmán", "musulmana", "judío", "judía",
    "protestante", "evangelico", "evangelica",
]
ES_LOCATIONS = [
    "España", "México", "Argentina", "Colombia", "Venezuela", "Perú", "Chile", "Ecuador",
    "Bolivia", "Paraguay", "Uruguay", "Costa Rica", "Panamá", "Guatemala", "Honduras",
    "El Salvador", "Nicaragua", "Cuba", "República Dominicana", "Puerto Rico", "Madrid",
    "Barcelona", "Bogotá", "Buenos Aires", "Lima", "Santiago", "Caracas", "Quito", "La Paz",
    "Montevideo", "San José", "Ciudad de Panamá", "Tegucigalpa", "San Salvador", "Managua",
    "La Habana", "Santo Domingo", "San Juan",
]

# Spam words: one common part and a few words per year
SPAM_COMMON = [
    "subscribe", "promocode", "free money", "check my channel", "vs mention", "href",
    "happy new year", "anyone here", "who is here", "2018", "br", "world population",
    "8 billion", "views", "anyone", "still watching", "song", "red_heart", "love", "its",
    "listening", "viewed", "billion", "world", "read", "reading", "reads", "population",
    "bilion", "sex", "gay", "porn", "pornhub", "cancer", "hot girl", "brbr", "brbrbr",
    "fuck", "shit", "4b", "3b", "1b", "2", "5b", "6b", "7b", "8b", "who39s", "channel",
    "sub", "suscribe", "million", "milon", "subs", "dislikes", "disslike", "die", "kill",
    "dead", "suicide", "birthday", "sexy",
]
SPAM_BY_YEAR = {
    2016: ["first comment", "early viewer", "just dropped this", "support my channel",
           "react to this", "new remix"],
    2017: ["Justin Bieber remix", "Bieber fan", "watch this version", "Despacito reaction",
           "global hit", "stream now"],
    2018: ["2018 anyone", "anyone here in 2018", "2018 still watching", "4b views",
           "who is here 2018", "world is watching"],
    2019: ["2019 anyone", "watching in 2019", "who else in 2019", "still viral", "5b soon",
           "almost 6b"],
    2020: ["covid", "corona", "quarantine", "lockdown song", "stay home",
           "pandemic made me come back", "corona days"],
    2021: ["vaccine", "delta variant", "got vaxxed", "isolation vibes", "watching after vaccine",
           "covid throwback"],
    2022: ["ukraine war", "news brought me here", "world war 3", "war update",
           "back again because of news", "global crisis"],
    2023: ["chatgpt remix", "AI cover", "TikTok brought me", "trending again",
           "back from TikTok", "AI sings Despacito"],
    2024: ["vote now", "elections brought me", "deepfake music", "politics in the comments",
           "viral again", "old is gold"],
    2025: ["2025 anyone?", "still here in 2025", "a decade later", "10 year anniversary",
           "timeless?", "future classic", "remember this?"],
}

# Tourism and travel
TOURISM = [
    "puerto rico", "visit", "vacation", "tourist", "tourism", "travel", "destination", "beach",
    "island", "resort", "hotel", "trip", "visit puerto rico", "beautiful place", "san juan",
    "caribbean", "beautiful country", "paradise", "place to visit", "vacation spot",
    "landscape", "scenery", "venue", "location",
]
TOURISM_EXTENDED = TOURISM + ["la perla", "old san juan"]
TRAVEL = [
    "travel", "experience", "visit", "city", "adventure", "sightseeing", "destination",
    "explore", "vacation", "trip", "tour", "journey", "summer", "advise", "holiday", "tourist",
    "food",
]

# Stop words
STOP_EN = [
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "a", "an",
    "is", "are", "was", "were", "this", "that", "it", "i", "you", "he", "she", "we", "they",
]
STOP_MIXED = [
    "the", "a", "an", "and", "is", "in", "it", "to", "for", "with", "this", "that", "of", "on",
    "at", "by", "from", "as", "was", "were", "be", "been", "being", "am", "are", "i", "you",
    "he", "she", "they", "we", "me", "my", "your", "his", "her", "their", "our", "its", "de",
    "la", "el", "en", "y", "que", "los", "las", "es", "un", "una", "del", "se", "por", "con",
    "no", "si", "al", "lo", "como", "mas", "pero", "sus", "le", "ya", "o", "muy", "sin",
    "sobre", "mi", "tu", "hasta", "porque", "cuando", "quien", "donde", "solo", "yo", "te",
    "esta", "este", "estos", "estas", "aquel",
]
STOP_ES = [
    "el", "la", "de", "que", "y", "a", "en", "un", "es", "se", "no", "te", "lo", "le", "da",
    "su", "por", "son", "con", "para", "al", "del", "los", "las", "una", "pero", "sus", "ha",
    "me", "si", "sin", "sobre", "este", "ya", "entre", "cuando", "todo", "esta", "ser", "dos",
    "también", "fue", "había", "muy", "hasta", "desde", "está", "mi", "porque", "qué", "sólo",
    "han", "yo", "hay", "vez", "puede", "todos", "así", "nos", "ni", "parte", "tiene", "él",
    "uno", "donde", "bien", "tiempo", "mismo", "ese", "ahora", "cada", "e", "vida", "otro",
    "después", "otros", "aunque", "esa", "eso", "hace", "otra", "gobierno", "tan", "durante",
    "siempre", "día", "tanto", "ella", "tres", "sí", "dijo", "años", "antes", "estado",
    "nunca", "agua", "menos", "nuevo", "debe", "casa", "país", "hecho", "general", "mayor",
    "propio", "año", "trabajo", "hombre", "mundo", "caso", "mujer", "forma", "lugar", "grupo",
    "momento", "número", "manera", "empresa", "horas", "ciudad", "problem", "hora", "fin",
    "medio", "millones", "hacia", "punto", "además", "ejemplo", "desarrollo",
]

# Labels
EMOTIONS = ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]
TRUE_STRINGS = ["true", "1", "t", "y", "yes", "spam"]

# Seed sentences of the small sentiment model
SENTIMENT_SEED = [
    ("This is amazing! I love it!", "positive"),
    ("Great video, very informative", "positive"),
    ("Best content I've seen in a while", "positive"),
    ("This is terrible, I hate it", "negative"),
    ("Waste of time, very disappointing", "negative"),
    ("Not worth watching at all", "negative"),
    ("The quality is poor and unprofessional", "negative"),
    ("Excellent work, keep it up!", "positive"),
    ("I learned so much from this", "positive"),
    ("This is exactly what I needed", "positive"),
    ("Complete garbage, don't bother", "negative"),
    ("Could have been better", "negative"),
    ("Not what I expected, very bad", "negative"),
    ("Absolutely fantastic!", "positive"),
    ("Very helpful and well explained", "positive"),
]
# ------------------------------------------------------------ end fixed values

# Common function words per language, our own choice, for language voting.
LANGUAGE_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "von", "den", "zu",
           "auf", "für", "dem", "sich", "ich", "auch", "als", "wie"],
    "en": ["the", "and", "of", "to", "is", "in", "that", "it", "for", "with", "was", "on",
           "are", "this", "be", "by", "at", "you", "have", "from"],
    "es": ["el", "los", "las", "y", "que", "del", "una", "por", "con", "para", "es", "no", "se",
           "su", "lo", "como", "más", "pero", "muy", "al"],
    "fr": ["le", "les", "et", "des", "est", "une", "du", "dans", "pour", "qui", "pas", "sur",
           "au", "par", "avec", "ce", "il", "sont", "vous", "je"],
}

# Templates for synthetic comments, our own wording.
SYNTHETIC_TEMPLATES = {
    "anger": ["{topic} makes me so {word}", "honestly {word} about {topic}",
              "nobody asked for {topic}, I am {word}"],
    "disgust": ["{topic} is plainly {word}", "how is {topic} not {word} to everyone",
                "what a {word} thing, {topic}"],
    "fear": ["{topic} keeps me awake, I feel {word}", "so {word} after hearing {topic}",
             "I got {word} when I saw {topic}"],
}
SYNTHETIC_WORDS = {
    "anger": ["livid", "fuming", "seething", "cross"],
    "disgust": ["rancid", "foul", "putrid", "ghastly"],
    "fear": ["afraid", "scared", "terrified", "uneasy"],
}
SYNTHETIC_TOPICS = ["this whole affair", "the last scene", "that kind of talk", "the noise outside",
                    "the latest news"]
