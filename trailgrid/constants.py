"""Fixed values the results depend on: word lists, tables, limits and patterns."""

import math

# ---------------------------------------------------------------- fixed values
EARTH_RADIUS_KM = 6371.0088

CATEGORIES = ("nature", "culture", "food", "viewpoint", "attraction", "lodging")
DEFAULT_EXCLUDED = ("lodging",)
OUTDOOR = ("nature", "viewpoint")
INDOOR = ("culture", "attraction")
SERVICES = ("food", "lodging")
NOT_ANCHORABLE = ("food", "lodging")

MAX_LIMIT = 200
MAX_RADIUS_M = 100_000
MAX_PER_CATEGORY = 50
SERVICES_RADIUS_M = 2_000
BEACH_RADIUS_M = 2_500
BEACH_LIMIT = 30

# --- classification: (tag key, accepted values, category); () accepts any value
TAG_RULES = (
    ("tourism", ("viewpoint",), "viewpoint"),
    ("tourism", ("museum", "gallery", "artwork"), "culture"),
    ("tourism", ("attraction", "theme_park", "zoo", "aquarium"), "attraction"),
    ("tourism", ("hotel", "hostel", "guest_house", "resort"), "lodging"),
    ("historic", (), "culture"),
    ("amenity", ("restaurant", "cafe", "bar", "fast_food", "ice_cream", "marketplace", "pub"), "food"),
    ("amenity", ("theatre", "arts_centre"), "culture"),
    ("natural", ("beach", "volcano", "peak", "spring", "cave_entrance"), "nature"),
    ("waterway", ("waterfall",), "nature"),
    ("leisure", ("park", "nature_reserve", "garden"), "nature"),
    ("shop", ("mall",), "attraction"),
)
BUILDING_LODGING = ("hotel", "hostel", "motel")
LODGING_NAME = (
    r"(?i)\b(hotel|hostal|hostel|posada|motel|suites?|resort|lodge|inn|albergue|caba[nñ]as?)\b"
)

GENERIC_NAMES = (
    "mirador", "miradores", "cascada", "cascadas", "museo", "el museo", "parque", "el parque",
    "playa", "la playa", "iglesia", "la iglesia", "restaurante", "cafe", "cafeteria", "hotel",
    "comedor", "pupuseria", "tienda", "bar", "mercado", "el mercado", "rio", "el rio", "puente",
    "escuela", "plaza", "la plaza", "cancha", "volcan", "el volcan", "panoramico", "vista", "lago",
    "laguna", "salto", "poza", "finca", "piscina", "piscinas", "la piscina", "balneario", "cerro",
    "el cerro", "cueva", "la cueva", "ruinas", "monumento", "parroquia", "ermita", "gasolinera",
    "cementerio", "estadio", "turicentro",
)
NOT_A_DESTINATION = (
    r"(?i)^(letrero|rotulo|señal|senal|hito|monolito|km\s|kilometro|deslave|"
    r"derrumbe|acceso|entrada a|desvio)\b"
)
CLOCK_TIME = r"\d{1,2}:\d{2}"
HOUR_RANGE = r"(?i)\b\d{3,4}\s*(?:a|-|hasta)\s*\d{3,4}\b"
WEEKDAY_WORD = r"\b(lunes|martes|miercoles|jueves|viernes|sabado|domingo)\b"
BARE_HOUR = r"\b\d{3,4}\b"
NAME_LETTER = r"[a-zA-ZáéíóúñÁÉÍÓÚÑ]"
STREET_NAME = r"(?i)^\s*\d+\s*(a|ª|o|º|era|nda|ra|ta|va)?\.?\s+(calle|avenida|av)\b"
MIN_NAME_LENGTH = 4

# --- name matching
ACCENTED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ’¡¿"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy'!?"
NAME_SIMILARITY = 0.3
DEDUPE_SIMILARITY = 0.55
DEDUPE_URBAN_M = 150
DEDUPE_OUTDOOR_M = 500
SAME_SITE_M = 1_500
RARE_WORD_SHARE = 0.001
RARE_WORD_MIN = 3
EMPTY_WORDS = ("el", "la", "los", "las", "de", "del", "y", "e", "a", "al")
CANDIDATE_SIMILARITY = 0.6
CANDIDATE_LIMIT = 8
NEARLY_EXACT = 0.85
FIT_MIN = 0.95
FIT_LEAD = 0.10
FIT_SUGGEST = 0.80
GAZETTEER_SIMILARITY = 0.50
ANCHOR_SIMILARITY = 0.45
DEFAULT_AREA_RADIUS_M = 15_000
GAZETTEER_ORDER = (
    "neighbourhood", "suburb", "admin8", "village", "town", "city", "admin6", "admin4",
)
CONNECTORS = (
    "a", "al", "con", "de", "del", "e", "en", "o", "para", "por", "sin", "sobre", "u", "y",
)
GENERIC_HEADS = (
    "mirador", "cerro", "peña", "pena", "cascada", "cascadas", "playa", "museo", "iglesia",
    "parque", "monumento", "ruinas", "loma", "pico", "volcan", "volcán", "laguna", "rio", "río",
    "puente", "plaza",
)

# --- cuisine label by tag value
CUISINES = {
    "pupusa": "pupusas", "pupusas": "pupusas", "pupuseria": "pupusas",
    "salvadoran": "salvadoreña", "salvadorean": "salvadoreña", "salvadoreña": "salvadoreña",
    "tex-mex": "tex-mex", "tacos": "tacos", "burritos": "burritos", "hot_dog": "hot dogs",
    "wings": "alitas", "juice": "jugos", "cake": "pasteles", "crepe": "crepas",
    "bubble_tea": "bubble tea", "cuban": "cubana", "german": "alemana",
    "regional": "comida típica", "local": "comida típica", "latin_american": "latinoamericana",
    "central_american": "centroamericana", "mexican": "mexicana", "italian": "italiana",
    "pizza": "pizza", "burger": "hamburguesas", "chicken": "pollo", "seafood": "mariscos",
    "fish": "pescado", "steak_house": "carnes", "barbecue": "parrilla", "grill": "parrilla",
    "chinese": "china", "japanese": "japonesa", "sushi": "sushi", "asian": "asiática",
    "american": "americana", "international": "internacional", "coffee_shop": "café",
    "cafe": "café", "bakery": "panadería", "ice_cream": "helados", "dessert": "postres",
    "sandwich": "sándwiches", "breakfast": "desayunos", "vegetarian": "vegetariana",
    "vegan": "vegana", "spanish": "española", "peruvian": "peruana", "argentinian": "argentina",
    "brazilian": "brasileña", "french": "francesa", "indian": "india", "thai": "tailandesa",
    "turkish": "turca", "greek": "griega",
}
GENERIC_CUISINES = ("regional", "local")
CUISINES_THAT_ARE_MEALS = ("breakfast",)
MAX_ELEVATION_M = 2_800

OPEN_STATES = ("abierto", "desconocido", "cerrado")

# --- zones: key, name, lat, lon, radius (m), aliases, aliases valid only as the whole text
ZONES = (
    ("san-salvador", "San Salvador", 13.6929, -89.2182, 15_000, ("capital",), ()),
    ("santa-ana", "Santa Ana", 13.9942, -89.5597, 25_000, (), ()),
    ("ataco", "Concepcion de Ataco", 13.8697, -89.8467, 20_000,
     ("ruta de las flores", "ruta de la flores", "las flores"), ()),
    ("juayua", "Juayua", 13.8414, -89.7461, 12_000, (), ()),
    ("apaneca", "Apaneca", 13.8547, -89.8036, 12_000, (), ()),
    ("nahuizalco", "Nahuizalco", 13.7789, -89.7375, 10_000, (), ()),
    ("suchitoto", "Suchitoto", 13.9356, -89.0272, 15_000, (), ()),
    ("sonsonate", "Sonsonate", 13.7189, -89.7242, 15_000, (), ()),
    ("ahuachapan", "Ahuachapan", 13.9214, -89.8450, 15_000, (), ()),
    ("la-libertad", "La Libertad", 13.4883, -89.3222, 20_000,
     ("puerto de la libertad", "surf city", "surfcity"),
     ("la playa", "las playas", "playa", "playas", "la costa", "costa", "el mar", "surf city")),
    ("el-tunco", "Playa El Tunco", 13.4936, -89.3819, 15_000, ("el tunco", "tunco"), ()),
    ("el-zonte", "Playa El Zonte", 13.4936, -89.4400, 12_000, ("el zonte",), ()),
    ("costa-del-sol", "Costa del Sol", 13.3167, -88.9167, 20_000, (), ()),
    ("san-miguel", "San Miguel", 13.4833, -88.1833, 20_000, (), ()),
    ("metapan", "Metapan", 14.3333, -89.4500, 25_000, (), ()),
    ("la-palma", "La Palma", 14.3167, -89.1667, 15_000, (), ()),
    ("alegria", "Alegria", 13.5069, -88.4897, 12_000, (), ()),
    ("perquin", "Perquin", 13.9564, -88.1583, 15_000, (), ()),
    ("coatepeque", "Lago de Coatepeque", 13.8667, -89.5500, 15_000,
     ("coatepeque", "lago coatepeque"), ()),
    ("cerro-verde", "Cerro Verde", 13.8258, -89.6314, 18_000,
     ("volcan de izalco", "izalco", "santa ana volcan"), ()),
)
ZONE_MIN_DESTINATIONS = 8
NAME_MIN_DESTINATIONS = 4

# --- road detour: lat, lon, radius (km), factor
DETOUR_NATIONAL = 1.53
DETOUR_BY_ZONE = (
    (13.9214, -89.845, 15.0, 1.47),
    (13.5069, -88.4897, 12.0, 1.59),
    (13.8547, -89.8036, 12.0, 1.53),
    (13.8697, -89.8467, 20.0, 1.53),
    (13.8258, -89.6314, 18.0, 1.55),
    (13.8667, -89.55, 15.0, 1.45),
    (13.3167, -88.9167, 20.0, 1.61),
    (13.4936, -89.3819, 15.0, 1.44),
    (13.4936, -89.44, 12.0, 1.65),
    (13.8414, -89.7461, 12.0, 1.61),
    (13.4883, -89.3222, 20.0, 1.50),
    (14.3167, -89.1667, 15.0, 2.19),
    (14.3333, -89.45, 25.0, 1.74),
    (13.7789, -89.7375, 10.0, 1.39),
    (13.9564, -88.1583, 15.0, 1.96),
    (13.4833, -88.1833, 20.0, 1.38),
    (13.6929, -89.2182, 15.0, 1.36),
    (13.9942, -89.5597, 25.0, 1.37),
    (13.7189, -89.7242, 15.0, 1.39),
    (13.9356, -89.0272, 15.0, 1.80),
)
# straight-line km below which the speed (km/h) holds; the last one is open
SPEED_BANDS = ((2.0, 35.0), (10.0, 41.0), (50.0, 56.0), (None, 62.0))
WALKING_KMH = 5.0
ARRIVAL_OVERHEAD_MIN = {"driving": 8, "walking": 2}
PLAUSIBLE_SHARE = 0.98
MATRIX_BLOCK = 50
CALIBRATION_MIN_KM = 0.5
CALIBRATION_MIN_PAIRS = 30
BANDS = (("menos de 2 km", 2.0), ("2 a 10 km", 10.0), ("10 a 50 km", 50.0), ("mas de 50 km", None))
SIMPLIFY_TOLERANCE_DEG = 0.00005

# --- gazetteer
KIND_RADIUS_KM = {
    "city": 12.0, "town": 8.0, "village": 5.0, "suburb": 5.0, "neighbourhood": 3.0,
}
KIND_RADIUS_DEFAULT_KM = 5.0
RADIUS_MIN_KM = 3.0
RADIUS_MAX_KM = 35.0
KM_PER_DEG_LAT = 110.574
KM_PER_DEG_LON = 111.320

# --- coast outline: lon, lat
COAST = (
    (-90.1, 13.669), (-90.0, 13.625), (-89.9, 13.490), (-89.8, 13.490), (-89.7, 13.490),
    (-89.6, 13.495), (-89.5, 13.485), (-89.4, 13.467), (-89.3, 13.432), (-89.2, 13.369),
    (-89.1, 13.322), (-89.0, 13.271), (-88.9, 13.270), (-88.8, 13.270), (-88.7, 13.225),
    (-88.6, 13.183), (-88.5, 13.168), (-88.4, 13.168), (-88.3, 13.167), (-88.2, 13.166),
    (-88.1, 13.159), (-88.0, 13.159), (-87.9, 13.159), (-87.8, 13.159), (-87.7, 13.166),
)
COASTAL_KM = 12.0
COAST_BAND_MIN = 3
# known places, and whether they lie on the coast
COAST_CONTROLS = (
    ("El Cuco", 13.1667, -88.1167, True),
    ("El Tunco", 13.4936, -89.3819, True),
    ("El Zonte", 13.4936, -89.4400, True),
    ("Costa del Sol", 13.3167, -88.9167, True),
    ("La Libertad", 13.4883, -89.3222, True),
    ("Santa Tecla", 13.6731, -89.2797, False),
    ("San Salvador", 13.6929, -89.2182, False),
    ("Ataco", 13.8697, -89.8467, False),
    ("Santa Ana", 13.9942, -89.5597, False),
    ("Suchitoto", 13.9356, -89.0272, False),
)

# --- weather and sea
RAIN_MM = 1.0
FIRST_RAIN_CODE = 51
WMO = {
    0: "cielo despejado", 1: "mayormente despejado", 2: "parcialmente nublado", 3: "nublado",
    45: "neblina", 48: "neblina con escarcha", 51: "llovizna ligera", 53: "llovizna",
    55: "llovizna intensa", 61: "lluvia ligera", 63: "lluvia", 65: "lluvia intensa",
    80: "chubascos ligeros", 81: "chubascos", 82: "chubascos fuertes", 95: "tormenta",
    96: "tormenta con granizo", 99: "tormenta con granizo",
}
WEATHER_HORIZON_DAYS = 16
SEA_HORIZON_DAYS = 7
KEY_DECIMALS = 2
ANSWER_SECONDS = 3600
COMPASS = (
    "del norte", "del noreste", "del este", "del sureste",
    "del sur", "del suroeste", "del oeste", "del noroeste",
)

# --- sun
# Spencer's series (1971): a constant, then (cosine, sine) at one, two ... times the angle of the year;
# the declination in radians, the equation of time in minutes.
YEAR_ANGLE = 2 * math.pi / 365
DECLINATION = (0.006918, (-0.399912, 0.070257), (-0.006758, 0.000907), (-0.002697, 0.00148))
TIME_EQUATION = (0.0171885, (0.42810824, -7.35140686), (-3.3494657, -9.36177382))
SUNSET_ZENITH = math.radians(90.833)
UTC_OFFSET_HOURS = -6

# --- calendar words
WEEKDAYS_ES = ("lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo")
MONTHS_ES = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)

# --- opening hours
WEEKDAY_TAGS = ("mo", "tu", "we", "th", "fr", "sa", "su")
DASHES = "‑‒–—−"
ALWAYS_OPEN = ("24/7", "24 hours", "24/7; ph off")
DAY_MIN = 1_440
WEEK_MIN = 10_080

# --- visits
SUBCATEGORY_MINUTES = {
    "museum": 120, "archaeological_site": 105, "ruins": 75, "pyramid": 75, "castle": 75,
    "gallery": 75, "arts_centre": 60, "manor": 60, "church": 30, "place_of_worship": 30,
    "wreck": 30, "monument": 20, "memorial": 20, "artwork": 15, "volcano": 180,
    "nature_reserve": 150, "beach": 150, "peak": 120, "garden": 120, "waterfall": 75,
    "cave_entrance": 60, "spring": 45, "park": 60, "theme_park": 210, "zoo": 150,
}
CATEGORY_MINUTES = {
    "viewpoint": 30, "food": 60, "culture": 75, "attraction": 90, "nature": 105, "lodging": 0,
}
MEAL_MINUTES = 90
MODES = ("driving", "walking")
ASKED_KM = (1.0, 500.0)
VISIT_MINUTES = (10, 480)
DAY_STARTS, DAY_ENDS = 540, 1200
BREAKFAST_MINUTES = 45
APPEAL = {
    "volcano": 1.0, "waterfall": 1.0, "beach": 0.95, "nature_reserve": 0.9, "peak": 0.85,
    "viewpoint": 0.8, "museum": 0.8, "spring": 0.75, "cave_entrance": 0.75, "theme_park": 0.75,
    "zoo": 0.7, "attraction": 0.7, "archaeological_site": 0.85, "ruins": 0.75, "castle": 0.75,
    "gallery": 0.6, "theatre": 0.6, "arts_centre": 0.55, "monument": 0.5, "mall": 0.5,
    "memorial": 0.35, "garden": 0.5, "pyramid": 0.85, "manor": 0.6, "wreck": 0.6, "church": 0.55,
    "place_of_worship": 0.5, "park": 0.3, "artwork": 0.3, "wayside_cross": 0.2,
    "wayside_shrine": 0.2, "boundary_stone": 0.1, "stone": 0.1, "building": 0.1, "house": 0.1,
    "tomb": 0.25,
}
APPEAL_DEFAULT = 0.25
APPEAL_FLOOR = 0.45
VAGUE_SCORE = 0.5
VAGUE_KM = 10.0
SUBCATEGORY_CAP = {"mall": 1}
BEACH_LODGING_CAP = 1
CATEGORY_REPEAT_KM = 24.0
SUBCATEGORY_REPEAT_KM = 8.0
REQUIRED_KM = 60.0
REQUESTED_KM = 120.0
DAY_STOP_CAP = 12
CANDIDATES_PER_CATEGORY = 25

# --- plan limits
STATED_KM = {"driving": 25.0, "walking": 8.0}
UNSTATED_KM = {"driving": 60.0, "walking": 25.0}
DUSK_MIN = 18 * 60 + 15
INDOOR_CLOSE_MIN = 18 * 60
MEAL_WINDOWS = {
    "breakfast": (6 * 60 + 30, 9 * 60 + 30),
    "lunch": (11 * 60 + 30, 14 * 60 + 30),
    "dinner": (18 * 60, 21 * 60),
}
TYPICAL_TRAVEL_MIN = 12
TYPICAL_VISIT_MIN = 90
MEAL_EARLY_MIN = 30
MEAL_RESCUE_MIN = 45
MEAL_CANDIDATES = 8
MEAL_OPEN_BONUS_KM = 1.5
MEAL_KM_SHARE = 0.30
LONG_FAST_MIN = 300
SOFT_CHECKS = ("include_meals", "fuera_de_hora")
REQUIRABLE_SUBCATEGORIES = ("beach", "peak", "nature_reserve")

# --- request limits (requests, seconds)
PLAN_LIMITS = ((4, 60), (40, 86_400))
ITINERARY_LIMITS = ((12, 60), (120, 86_400))
QUOTA_SECONDS = 86_400
SHARE_ALPHABET = "23456789abcdefghjkmnpqrstuvwxyz"
SHARE_LENGTH = 10
# ------------------------------------------------------------ end fixed values
