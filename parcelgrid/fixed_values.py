"""Word lists, lookup tables and constants that results depend on.

Everything here is data, not logic.  The order of a table matters where the
comment says so (first hit wins).
"""

# --- Fixed values: currency, tax and asking-to-transaction factors -------------
BGN_PER_EUR = 1.95583
VAT_RATE = 1.20
ADJUSTMENT_FACTORS = {"MT": 0.97, "BG": 0.93, "CY": 0.94, "HR": 0.93}
DEFAULT_ADJUSTMENT = 0.95

# --- Fixed values: fields whose change is recorded in the history --------------
TRACKED_FIELDS = (
    "price_eur", "price_per_sqm", "price_adjusted_eur",
    "area_sqm", "bedrooms", "bathrooms", "rooms",
    "property_type", "locality", "title", "description",
    "condition", "is_active", "price_original", "price_currency",
    "address_raw", "floor", "total_floors",
)

# --- Fixed values: property types of the JSON API (exact key) ------------------
API_PROPERTY_TYPES = {
    "Apartment": "apartment",
    "Apartment Duplex": "apartment",
    "Block Of Apartments": "apartment",
    "FlatLet": "apartment",
    "Serviced Apartment": "apartment",
    "Penthouse": "penthouse",
    "Penthouse Duplex": "penthouse",
    "Penthouse Triplex": "penthouse",
    "Sky Villa": "penthouse",
    "Maisonette": "maisonette",
    "Maisonette Duplex": "maisonette",
    "Maisonette Semi-detached": "maisonette",
    "Maisonette Solitary": "maisonette",
    "Maisonette Solitary Duplex": "maisonette",
    "Maisonette Solitary Triplex": "maisonette",
    "Villa": "villa",
    "Villa Semi-detached": "villa",
    "Villa Detached": "villa",
    "Terraced House": "house",
    "Semi-Detached Villa": "house",
    "Townhouse": "house",
    "House of Character": "house",
    "Bungalow": "house",
    "Bungalow Detached": "house",
    "Bungalow Semi-detached": "house",
    "Palazzo": "house",
    "Palazzino": "house",
    "Farmhouse": "house",
    "Cottage": "house",
    "Guest House": "house",
    "Studio": "studio",
    "Studio Flat": "studio",
    "Room": "studio",
    "Garage": "parking",
    "Garage (Residential)": "parking",
    "Garage (Commercial)": "parking",
    "Car Space": "parking",
    "Boathouse": "parking",
    "Parking Lot": "parking",
    "Office": "commercial",
    "Office Space": "commercial",
    "Office Block": "commercial",
    "Managed Office": "commercial",
    "Shop": "commercial",
    "Showroom": "commercial",
    "Shopping Mall": "commercial",
    "Outlet Mall": "commercial",
    "Restaurant": "commercial",
    "Cafe": "commercial",
    "Bar": "commercial",
    "Pub": "commercial",
    "Take Away": "commercial",
    "Warehouse": "commercial",
    "Warehouse with Office Space": "commercial",
    "Factory": "commercial",
    "Industrial Estate Building": "commercial",
    "Self Storage": "commercial",
    "Salon/Hairdresser/Beautician": "commercial",
    "Sale of Business": "commercial",
    "Gymnasium": "commercial",
    "Fitness Centre": "commercial",
    "Rehabilitation Clinic": "commercial",
    "Pharmacy": "commercial",
    "School": "commercial",
    "Hotel": "commercial",
    "Boutique Hotel": "commercial",
    "Hostel": "commercial",
    "B&B": "commercial",
    "Old people's/Nursing Home": "commercial",
    "Gambling/Entertainment": "commercial",
    "Hall": "commercial",
    "Stables": "commercial",
    "Building": "commercial",
    "Plot": "land",
    "Land": "land",
    "Land for Development": "land",
    "Agriculture Land": "land",
    "Site": "land",
    "Site / Plot": "land",
    "Airspace (Residential)": "land",
    "Yard": "land",
}

# --- Fixed values: property types of the classifieds (lower-cased key) ---------
CLASSIFIED_PROPERTY_TYPES = {
    "apartment": "apartment",
    "apartment / flat": "apartment",
    "flat": "apartment",
    "penthouse": "penthouse",
    "maisonette": "maisonette",
    "villa": "villa",
    "detached villa": "villa",
    "semi-detached villa": "house",
    "terraced house": "house",
    "townhouse": "house",
    "house of character": "house",
    "bungalow": "house",
    "palazzo": "house",
    "palazzino": "house",
    "farmhouse": "house",
    "cottage": "house",
    "studio": "studio",
    "garage": "parking",
    "car space": "parking",
    "office": "commercial",
    "offices": "commercial",
    "shop": "commercial",
    "business outlet or shop": "commercial",
    "other commercial": "commercial",
    "industrial": "commercial",
    "warehouse": "commercial",
    "restaurant": "commercial",
    "plot": "land",
    "land": "land",
    "land (odz)": "land",
    "site": "land",
}

# --- Fixed values: Bulgarian title words (substring; first hit in order wins) --
CYRILLIC_PROPERTY_TYPES = {
    "1-стаен": "studio",
    "едностаен": "studio",
    "2-стаен": "apartment",
    "двустаен": "apartment",
    "3-стаен": "apartment",
    "тристаен": "apartment",
    "4-стаен": "apartment",
    "четиристаен": "apartment",
    "многостаен": "apartment",
    "мезонет": "maisonette",
    "ателие": "studio",
    "къща": "house",
    "вила": "villa",
    "етаж от къща": "house",
    "пентхаус": "penthouse",
    "гараж": "parking",
    "паркомясто": "parking",
    "офис": "commercial",
    "магазин": "commercial",
    "склад": "commercial",
    "бизнес имот": "commercial",
    "пром. помещение": "commercial",
    "заведение": "commercial",
    "хотел": "commercial",
    "парцел": "land",
    "земя": "land",
}

# --- Fixed values: agency title words (substring; first hit in order wins) -----
AGENCY_TITLE_TYPES = (
    ("penthouse", "penthouse"),
    ("maisonette", "maisonette"),
    ("villa", "villa"),
    ("house", "house"),
    ("bungalow", "house"),
    ("studio", "studio"),
    ("apartment", "apartment"),
    ("flat", "apartment"),
)

# --- Fixed values: room words ---------------------------------------------------
ROOM_WORDS = {
    "едностаен": 1, "двустаен": 2, "тристаен": 3, "четиристаен": 4, "многостаен": 5,
}

# --- Fixed values: finish text to condition (substring; first hit wins) ---------
CONDITION_WORDS = (
    (("shell",), "shell"),
    (("new", "plan"), "new"),
    (("excellent", "finish"), "excellent"),
    (("furnished",), "good"),
    (("good",), "good"),
    (("renovat",), "needs_renovation"),
)

# --- Fixed values: VAT phrases --------------------------------------------------
VAT_EXCLUDED_PHRASE = "без ДДС"
VAT_INCLUDED_PHRASE = "с включено ДДС"

# --- Fixed values: Bulgarian month names ----------------------------------------
BG_MONTHS = {
    "януари": 1, "февруари": 2, "март": 3, "април": 4,
    "май": 5, "юни": 6, "юли": 7, "август": 8,
    "септември": 9, "октомври": 10, "ноември": 11, "декември": 12,
}

# --- Fixed values: listing time hidden in a portal URL --------------------------
URL_TIME_PATTERN = r"obiava-\w{2}(\d{10})"
URL_TIME_MIN = 1400000000
URL_TIME_MAX = 2000000000

# --- Fixed values: amenity flags and the feature names that switch them on ------
AMENITY_KEYWORDS = {
    "has_balcony": ["Balcony"],
    "has_ac": ["A/C"],
    "has_ensuite": ["En Suite"],
    "has_lift": ["Lift", "Passenger Lift"],
    "has_double_glazed": ["Double Glazed"],
    "has_terrace": ["Terrace", "Roof Terrace"],
    "has_pool": ["Pool", "Communal Pool", "Pool Deck"],
    "has_ceramic_floor": ["Ceramic Floor"],
    "has_backyard": ["Back Yard"],
    "has_yard": ["Yard", "Court Yard"],
    "has_marble_floor": ["Marble Floor"],
    "has_walk_in_wardrobe": ["Walk in Wardrobe"],
    "has_alarm": ["Alarm System"],
    "has_video_intercom": ["Video Intercom", "Video Hall Porter"],
}
CLASSIFIED_AMENITY_FIELDS = {
    "has_balcony": "has_balcony", "has_lift": "has_elevator", "has_pool": "has_pool",
}
PORTAL_AMENITY_FIELDS = {
    "has_balcony": "has_balcony", "has_ac": "has_ac", "has_lift": "has_elevator",
    "has_alarm": "has_access_control", "has_video_intercom": "has_cctv",
    "has_yard": "has_garden",
}
PORTAL_AMENITY_MARKERS = ("has_ac", "has_elevator", "has_furnishing", "has_access_control")

# --- Fixed values: detail-page amenity words ------------------------------------
DETAIL_AMENITY_WORDS = {
    "has_furnishing": ["мебел"],
    "has_parking": ["паркомясто", "паркинг"],
    "has_garage": ["гараж"],
    "has_elevator": ["асансьор"],
    "has_balcony": ["балкон", "тераса"],
    "has_garden": ["градин", "двор"],
    "has_ac": ["климатик"],
    "has_access_control": ["контрол на достъпа"],
    "has_cctv": ["видео наблюдение", "видеонаблюдение"],
    "is_insulated": ["саниран"],
    "has_internet": ["интернет"],
}
PAGE_AMENITY_WORDS = {
    "has_parking": ["parking", "garage"],
    "has_pool": ["pool"],
    "has_garden": ["garden"],
    "has_elevator": ["lift", "elevator"],
    "has_balcony": ["balcony", "terrace"],
}
AGENCY_PHOTO_PATH = "/wp-content/plugins/property-market/files/"
API_DETAIL_AMENITY_WORDS = {
    "has_balcony": ["balcony", "terrace"],
    "has_pool": ["pool"],
    "has_garden": ["garden"],
    "has_elevator": ["lift", "elevator"],
    "has_parking": ["parking"],
}

# --- Fixed values: location-type names and resort words --------------------------
LOCATION_TYPES = {
    "is_near_beach": ["Near Beach"],
    "is_seafront": ["Seafront"],
    "is_sea_view": ["Sea View"],
    "is_quiet_road": ["On Quiet Road"],
    "is_city_center": ["Village Core (City Center)"],
    "is_countryside": ["Countryside", "Rural"],
}
RESORT_WORDS = [
    "к.к.", "Златни пясъци", "Слънчев бряг", "Слънчев ден",
    "Ален мак", "Св.Св. Константин", "Елените", "Приморско",
]
GOZO = "Gozo"
GOZO_PREFIX = "Gozo - "

# --- Fixed values: encodings of text-derived categories --------------------------
FURNISHING = {"unknown": 0, "unfurnished": 1, "partly_furnished": 2, "furnished": 3}
VIEW = {"unknown": 0, "none": 0, "garden": 1, "pool": 1, "city": 2, "valley": 3,
        "harbour": 4, "sea": 5}
QUALITY = {"budget": 1, "standard": 2, "premium": 3, "luxury": 4}
CONSTRUCTION = {"unknown": 0, "off_plan": 1, "under_construction": 2, "completed": 3}
RENOVATION_ERA = {"unknown": 0, "dated": 1, "recent": 2, "modern": 3}
PARKING = {"unknown": 0, "none": 0, "street": 1, "car_space": 2, "garage": 3,
           "double_garage": 4}
OUTDOOR = {"unknown": 0, "none": 0, "balcony": 1, "yard": 2, "garden": 3, "terrace": 4,
           "roof_terrace": 5}
FLOOR_CATEGORY = {"unknown": 0, "ground": 1, "low": 2, "mid": 3, "high": 4,
                  "penthouse_level": 5}
KITCHEN = {"unknown": 0, "kitchenette": 1, "separate": 2, "open_plan": 3}
ORIENTATION = {"unknown": 0, "north": 1, "west": 2, "east": 3, "south": 4}
CEILING = {"unknown": 0, "normal": 1, "high": 2, "double": 3}
NOISE = {"unknown": 0, "busy": 1, "moderate": 2, "quiet": 3}
LEASE = {"unknown": 0, "leasehold": 1, "freehold": 2}
FLOORING = {"unknown": 0, "concrete": 1, "tiles": 2, "wood": 3, "marble": 4}
CONSTRUCTION_TYPE = {"panel": 1, "epk": 2, "brick": 3}

TEXT_NUMERIC = ["condition", "floor", "total_floors", "outdoor_sqm", "building_units"]
TEXT_BOOLEAN = ["bright", "quiet", "sea_proximity", "is_investment", "is_new_build",
                "has_storage"]
TEXT_ORDINAL = {
    "furnishing": FURNISHING,
    "quality_tier": QUALITY,
    "construction_status": CONSTRUCTION,
    "floor_category": FLOOR_CATEGORY,
    "ceiling_height": CEILING,
    "noise_exposure": NOISE,
    "lease_type": LEASE,
}
TEXT_CATEGORICAL = {
    "view": VIEW,
    "parking_type": PARKING,
    "outdoor_space": OUTDOOR,
    "kitchen_type": KITCHEN,
    "orientation": ORIENTATION,
}
IMAGE_NUMERIC = ["interior_score", "kitchen_score", "bathroom_score",
                 "exterior_condition", "street_quality"]
IMAGE_ORDINAL = {"renovation_era": RENOVATION_ERA}
IMAGE_CATEGORICAL = {"flooring_type": FLOORING}

# --- Fixed values: keys of a text-enrichment response ----------------------------
RESPONSE_TEXT_FIELDS = {
    "condition": "long",
    "floor": "long",
    "total_floors": "long",
    "furnishing": "string",
    "view": "string",
    "construction_status": "string",
    "quality_tier": "string",
    "bright": "boolean",
    "quiet": "boolean",
    "sea_proximity": "boolean",
    "parking_type": "string",
    "outdoor_space": "string",
    "outdoor_sqm": "long",
    "floor_category": "string",
    "building_units": "long",
    "kitchen_type": "string",
    "orientation": "string",
    "is_investment": "boolean",
    "is_new_build": "boolean",
    "has_storage": "boolean",
    "ceiling_height": "string",
    "noise_exposure": "string",
    "lease_type": "string",
    "location_reference": "string",
    "actual_living_area": "long",
    "is_house_floor": "boolean",
    "area_includes_extra": "boolean",
    "data_quality_note": "string",
}
RESPONSE_IMAGE_FIELDS = {
    "interior_score": "long",
    "renovation_era": "string",
    "photo_view": "string",
    "kitchen_score": "long",
    "bathroom_score": "long",
    "flooring_type": "string",
    "exterior_condition": "long",
    "street_quality": "long",
}
CLAMPED_SCORES = ("condition", "interior_score", "kitchen_score", "bathroom_score",
                  "exterior_condition", "street_quality")

# --- Fixed values: country boxes and named places --------------------------------
COUNTRY_BOXES = {"MT": (35.7, 36.1, 14.1, 14.6), "BG": (41.0, 44.5, 22.0, 29.0)}
KEY_LOCATIONS = {
    "MT": {"sliema": (35.9116, 14.5027), "stjulians": (35.9186, 14.4903)},
    "BG": {
        "sofia": (42.6977, 23.3219),
        "plovdiv": (42.1354, 24.7453),
        "varna": (43.2141, 27.9147),
        "burgas": (42.5048, 27.4626),
        "sea": (42.4, 27.7),
    },
}
CBD = (35.8989, 14.5146)

# --- Fixed values: coast rings, (lon, lat) ----------------------------------------
COAST_RINGS = (
    (
        (14.5146, 35.8989), (14.5366, 35.9025), (14.5621, 35.8236),
        (14.5435, 35.8100), (14.5200, 35.8050), (14.4700, 35.8190),
        (14.4200, 35.8350), (14.3500, 35.8600), (14.3340, 35.8850),
        (14.3430, 35.9100), (14.3600, 35.9300), (14.3850, 35.9420),
        (14.4200, 35.9530), (14.4500, 35.9580), (14.4800, 35.9590),
        (14.5080, 35.9550), (14.5146, 35.8989),
    ),
    (
        (14.2100, 36.0300), (14.2600, 36.0550), (14.2900, 36.0570),
        (14.3100, 36.0500), (14.3200, 36.0350), (14.3000, 36.0200),
        (14.2500, 36.0150), (14.2100, 36.0300),
    ),
)
# --- Fixed values: coast sample points, (lat, lon) --------------------------------
COAST_POINTS = (
    (35.8989, 14.5146), (35.9025, 14.5366), (35.8236, 14.5621), (35.8100, 14.5435),
    (35.8050, 14.5200), (35.8190, 14.4700), (35.8350, 14.4200), (35.8600, 14.3500),
    (35.8850, 14.3340), (35.9300, 14.3600), (35.9530, 14.4200), (35.9590, 14.4800),
    (36.0300, 14.2100), (36.0550, 14.2600), (36.0570, 14.2900), (36.0350, 14.3200),
    (36.0150, 14.2500),
)

# --- Fixed values: points of interest ----------------------------------------------
POI_DISTANCE_FEATURES = {
    "dist_school_km": ["schools"],
    "dist_bus_km": ["bus_stops"],
    "dist_supermarket_km": ["supermarkets"],
    "dist_restaurant_km": ["restaurants", "cafes"],
    "dist_hospital_km": ["hospitals", "clinics"],
    "dist_pharmacy_km": ["pharmacies"],
    "dist_park_km": ["parks"],
    "dist_worship_km": ["worship"],
    "dist_beach_km": ["beaches"],
    "dist_marina_km": ["marinas"],
    "dist_airport_km": ["airports"],
    "dist_kindergarten_km": ["kindergartens"],
    "dist_university_km": ["universities"],
}
DINING_CATEGORIES = ("restaurants", "cafes")
POI_RADIUS_KM = 0.5
DEG_TO_KM = (111.0 + 89.8) / 2
PLANAR_LAT_KM = 111.0
PLANAR_LON_KM = 89.0
EARTH_RADIUS_KM = 6371.0

# --- Fixed values: training bounds per (property type, listing type) ---------------
TRAINING_BOUNDS = {
    ("apartment", "sale"): dict(min_price=50_000, max_price=5_000_000, min_area=15,
                                max_area=500, require_area=True),
    ("apartment", "rent"): dict(min_price=300, max_price=10_000, min_area=15,
                                max_area=500, require_area=False),
    ("penthouse", "sale"): dict(min_price=100_000, max_price=10_000_000, min_area=30,
                                max_area=800, require_area=True),
    ("penthouse", "rent"): dict(min_price=500, max_price=20_000, min_area=30,
                                max_area=800, require_area=False),
}
SALE_PPSQM_BOUNDS = (100, 30_000)
ENSEMBLE_WEIGHTS = (0.85, 0.15)
N_FOLDS = 5

# --- Fixed values: features absent when a fresh request is scored ------------------
SERVE_ABSENT = (
    "listing_age_days", "listing_year", "listing_score",
    "city_population", "city_population_log", "rental_density_2km",
    "construction_type", "province_enc",
    "has_ac", "has_ensuite", "has_double_glazed", "has_terrace",
    "has_ceramic_floor", "has_backyard", "has_marble_floor",
    "has_walk_in_wardrobe", "has_alarm", "has_video_intercom",
)
MONOTONE_SIZE_FEATURES = ("area_sqm", "area_sqm_log", "bedrooms", "bathrooms", "rooms",
                          "total_int_area", "total_ext_area")

# --- Fixed values: one-hot columns --------------------------------------------------
ONE_HOT_TYPES = ("apartment", "house", "villa", "studio", "maisonette", "penthouse")
ONE_HOT_CONDITIONS = ("new", "excellent", "good", "needs_renovation")
REQUEST_NUMERICS = ("lat", "lon", "area_sqm", "floor", "rooms", "bedrooms", "year_built")
STORE_NUMERICS = ("lat", "lon", "area_sqm", "floor", "rooms", "bedrooms", "year_built",
                  "distance_coast_m", "distance_center_m")
STORE_BOOLEANS = ("has_parking", "has_garden", "has_pool", "has_elevator", "has_balcony")

# --- Fixed values: scoring a request -------------------------------------------------
STRUCTURAL_DEFAULTS = {"total_ext_area": 10.0, "rooms": 6.0, "bathrooms": 2.0,
                       "bedrooms": 2.0}
CONDITION_SCORES = {"new": 5, "excellent": 5, "good": 4, "needs_renovation": 2, "shell": 1}
HIGH_IMPACT_FEATURES = ("locality_enc", "province_enc", "total_int_area",
                        "total_ext_area", "llm_condition", "llm_quality_tier")
COMPLETENESS_FIELDS = ("floor", "rooms", "bedrooms", "bathrooms", "year_built", "condition",
                       "has_parking", "has_garden", "has_pool", "has_elevator",
                       "has_balcony")

# --- Fixed values: request quotas ------------------------------------------------------
HOURLY_QUOTA, DAILY_QUOTA, GLOBAL_DAILY_QUOTA = 5, 20, 500

# --- Fixed values: suspicious-listing words ----------------------------------------------
WANTED_WORDS = ("wanted", "looking for", "looking to buy", "searching for", "required")
WANTED_CYRILLIC_PATTERN = "тър[cс]и"
TITLE_PRICE_PATTERN = r"(?i)(\d[\d.,]*\d)\s*(?:€|eur)"

# --- Fixed values: place names --------------------------------------------------------------
MALTESE_LETTERS = ("ġĠħĦżŻċĊ", "gghhzzcc")
# First prefix in order wins, repeated until none fits.
ARTICLE_PREFIXES = (
    "tas-", "tal-", "tad-", "taz-", "ta'-", "ta' ", "ta-",
    "il-", "l-", "is-", "ix-", "iz-", "in-", "ir-", "id-", "it-", "ic-", "ig-",
    "hal-", "hal ", "haz-", "haz ", "had-", "had ",
)
PLACE_ALIASES = {
    "san giljan": "St Julian's",
    "san pawl il bahar": "St Paul's Bay",
    "bugibba": "St Paul's Bay",
    "qawra": "St Paul's Bay",
    "furjana": "Floriana",
    "bormla": "Cospicua",
    "birgu": "Vittoriosa",
    "citta vittoriosa": "Vittoriosa",
    "isla": "Senglea",
    "citta invicta": "Senglea",
    "belt valletta": "Valletta",
    "citta umilissima": "Cospicua",
}
FUZZY_CUTOFF = 0.82
# Classified-site locality names to centroid names; None means "leave without a place".
CLASSIFIED_LOCALITIES = {
    "Rabat (Gozo)": "Gozo - Victoria",
    "Qala (Gozo)": "Gozo - Qala",
    "Xaghra (Gozo)": "Gozo - Xaghra",
    "Nadur (Gozo)": "Gozo - Nadur",
    "Marsalforn (Gozo)": "Gozo - Marsalforn",
    "Ghajnsielem (Gozo)": "Gozo - Ghajnsielem",
    "Xewkija (Gozo)": "Gozo - Xewkija",
    "Sannat": "Gozo - Sannat",
    "Xlendi (Gozo)": "Gozo - Xlendi",
    "Kercem (Gozo)": "Gozo - Kercem",
    "Gharb (Gozo)": "Gozo - Gharb",
    "Zebbug (Gozo)": "Gozo - Zebbug",
    "Ghasri": "Gozo - Ghasri",
    "San Lawrenz (Gozo)": "Gozo - San Lawrenz",
    "Munxar (Gozo)": "Gozo - Munxar",
    "Fontana (Gozo)": "Gozo - Fontana",
    "Zebbug (Malta)": "Zebbug",
    "Rabat (Malta)": "Rabat",
    "San Giljan": "St Julian's",
    "San Pawl il-Bahar": "St Paul's Bay",
    "Birzebbugia": "Birzebbuga",
    "Pieta'": "Pieta",
    "G'Mangia": "Gzira",
    "Ibragg": "Ta' l-Ibragg",
    "Swatar": "Msida",
    "Birgu": "Birgu",
    "Bugibba": "Bugibba",
    "Qawra": "Qawra",
    "Bahrija": "Rabat",
    "Kappara": "San Gwann",
    "San Pawl tat-Targa": "Naxxar",
    "Bormla": "Bormla",
    "Isla": "Isla",
    "Santa Lucija": "Santa Lucija",
    "Zebbiegh": "Mgarr",
    "Manikata": "Mellieha",
    "Burmarrad": "St Paul's Bay",
    "Fontana": "Gozo - Fontana",
    "Buskett": "Rabat",
    "Xemxija": "Xemxija",
    "Bidnija": "Mosta",
    "Madliena": "Swieqi",
    "Salina": "Naxxar",
    "Bahar ic-Caghaq": "Naxxar",
    "Birguma": "Naxxar",
    "Hal-Far": "Birzebbuga",
    "Wardija": "Rabat",
    "Paceville": "St Julian's",
    "Maghtab": "Naxxar",
    "Ta' Qali": "Attard",
    "*Outside Malta": None,
}

# --- Fixed values: columns of exports and stored documents ---------------------------------------
EXPORT_COLUMNS = (
    "external_id", "source", "listing_type", "property_type", "locality",
    "lat", "lon", "area_sqm", "bedrooms", "price_eur", "price_per_sqm",
    "url", "listing_date",
)
MIGRATED_FIELDS = (
    "title", "description", "url",
    "address_raw", "address_normalized", "locality", "lat", "lon",
    "property_type", "area_sqm", "floor", "total_floors",
    "rooms", "bedrooms", "bathrooms",
    "year_built", "year_renovated", "condition",
    "construction_type", "energy_class",
    "has_parking", "has_garden", "has_pool", "has_elevator",
    "has_balcony", "has_furnishing", "has_garage",
    "price_eur", "price_original", "price_currency",
    "price_type", "price_per_sqm", "price_adjusted_eur",
    "agent_name", "agent_company", "agent_phone", "agent_url",
    "listing_date", "transaction_date",
    "image_urls", "image_local_paths",
    "is_active",
)
JSON_TEXT_FIELDS = ("image_urls", "image_local_paths")
