"""Fixed values of the listing domain: allowed values, word lists, patterns, thresholds."""

from __future__ import annotations

# The enumerations of the domain.
KINDS = ("nieruchomosc", "licytacja", "przetarg", "wykaz", "inne")
TRANSACTIONS = ("sprzedaz", "wynajem", "dzierzawa", "zamiana", "nieznany")
PROPERTY_TYPES = ("mieszkanie", "dom", "dzialka", "lokal", "biuro", "magazyn", "hala", "garaz", "gospodarstwo", "kamienica", "pokoj", "inne")
SELLER_TYPES = ("prywatna", "posrednik", "deweloper", "komornik", "syndyk", "urzad", "instytucja", "nieznany")
STATUSES = ("aktywna", "nieaktywna", "archiwalna")

# Search.
PERIODS = {"dzis": 1, "7dni": 7, "30dni": 30, "90dni": 90, "1rok": 365}
PAGE_SIZE, MAX_PAGE_SIZE = 25, 100
FULLTEXT_COLUMNS = ("title", "description", "street", "case_number", "authority", "seller_name")
STREET_PREFIX = r"(?iu)^\s*(?:ul(?:ica|icy)?|al(?:eja|eje|ei)?|os(?:iedle|iedlu)?|pl(?:ac)?|skwer|rondo|bulwar|droga)\b\.?\s*"
ADJECTIVE_ENDING = r"(?<=[a-z]{4})(?:iej|ej|a)$"
HOUSE_NUMBER = r"^(.*?)[,\s]+(\d+[A-Za-z]?(?:/\d+[A-Za-z]?)?)\s*$"

# Market statistics.
COMPARABLE_TYPES = ("mieszkanie", "dom", "kamienica", "lokal", "biuro", "garaz", "dzialka")
MARKET_LEVELS = ("miasto", "powiat", "wojewodztwo")
NOT_COMPARABLE = (
    r"(?iU)\bROD\b|rodzinnych ogrod|ogrodzie dzia[łl]kow|\baltan|domek holendersk|"
    r"\bkontener|pawilon|modu[łl]ow|barakow[oó]z|\bblaszak|\bkiosk|"
    r"kwater\w*\s+(?:pracownicz|dla)|noclegi|nocleg\w*|za\s+dob[ęe]|na\s+doby|"
    r"agroturyst|\bhostel|apartament\w*\s+na\s+doby|\bmiejsce\s+noclegow"
)
MIN_SAMPLE, MIN_RATIO, BARGAIN_RATIO = 8, 0.35, 0.85

# Similar offers and duplicates.
SIMILAR_LOW, SIMILAR_HIGH, SIMILAR_POOL, SIMILAR_LIMIT = 0.75, 1.3, 300, 8
DEDUP_WINDOW_DAYS, AREA_TOLERANCE = 400, 1.5
TEXT_LIMIT, DESCRIPTION_LIMIT, CORROBORATION_LIMIT, MIN_DESCRIPTION = 88, 80, 80, 200
PRICE_CORROBORATES, PRICE_SPREAD = 0.05, 0.25

# Prices and areas.
MIN_SALE_PRICE, MAX_PRICE = 15_000, 300_000_000
PLACEHOLDER_PRICE = r"^(?:1234567890|123456789|(\d)\1{7,})$"
AREA_LIMITS = {
    "mieszkanie": (8, 1000),
    "pokoj": (4, 120),
    "dom": (20, 3000),
    "garaz": (5, 200),
    "kamienica": (50, 10000),
    "biuro": (5, 20000),
    "lokal": (5, 20000),
    "dzialka": (30, 5_000_000),
    "gospodarstwo": (100, 20_000_000),
    "hala": (20, 200_000),
    "magazyn": (20, 200_000),
}
OTHER_AREA_LIMITS = (0.5, 5_000_000)
LAND_TYPES = ("dzialka", "gospodarstwo")

# Patterns that read numbers and facts out of Polish text (Java syntax).
NUMBER = r"(\d{1,3}(?:[ \u00a0]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)"
AREA = r"(?iu)(\d{1,3}(?:[ \u00a0]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)\s*(?:m2|m²|mkw|m\.kw|metrów kwadratowych|metrów|metry)"
ROOMS = r"(?iu)(\d+)[\s-]*(?:pokoj|pokoi|pok\.|pokoje|pokój|pokojow)"
FLOOR = r"(?iU)(?:piętro|pietro)[:\s]*(\d+|parter\w*)"
FLOOR_OF = r"(?iU)(\d+|parter\w*)\s*piętro\s*z\s*(\d+)"
GROUND_FLOOR = r"(?iU)\bparter\w*"
YEAR = r"(?iU)(?:rok budowy|wybudowan\w*|z roku)[:\s]*((?:1[89]|20)\d{2})"
UNIT = r"(m2|m²|mkw|m\.kw|ha|hektar\w*|ar(?:ach|ami|owi|[oó]w|y|a|ze|em)?|a)\b"
PLOT = r"(?iU)(?:powierzchni\w*\s+(?:dzia[łl]ki|gruntu|terenu|nieruchomo[śs]ci)|dzia[łl]k\w*|grunt\w*|teren\w*|parcel\w*|area[łl])[^\d\n]{0,28}?" + NUMBER + r"\s*" + UNIT
CASE_NUMBER = r"(?U)\b((?:K[Mm]|GKm|Kmp|Kms|GKM|KM)\s?\d+/\d+)\b"
COURT_SIGN = r"(?U)\b([IVX]+\s?[A-Za-z]{1,4}\s?\d+/\d+)\b"
MIN_SHINGLE_WORDS, SHINGLE_WORDS, SHINGLES_KEPT = 12, 5, 64

# What titles say.
NOISE = r"(?iU)\b(kupię|kupie|poszukuję|poszukuje|skup (mieszkań|nieruchomości)|zamienię|kredyt|doradztwo|remont|usługi|sprzątanie|projekt wnętrz)\b"
NAVIGATION = r"(?iU)^\s*(?:polecane|wyr[oó]żnione|podobne|ostatnio ogl[ąa]dane|najnowsze|wyniki wyszukiwania|lista ofert|oferty|nieruchomo[śs]ci|zobacz|więcej|strona \d+|wszystkie)\b[^,:]{0,40}$"
RENT_IN_TITLE = r"(?iU)\bdo wynaj|\bna wynaj|\bwynajm|\bwynajem\b|\bdo zamieszkania od zaraz za\b"
LEASE_IN_TITLE = r"(?iU)\bdzierżaw|\bwydzierżaw|\boddam w dzierżaw"
PRIMARY_MARKET = r"(?iu)rynek pierwotn|pierwotny|od dewelopera|nowa inwestycja"
SECONDARY_MARKET = r"(?iu)rynek wtórn|wtorny|używan"
PROPERTY_HINTS = (
    ("mieszkanie", r"(?iU)\bmieszkan|\bmieszkaln|\bapartament|\bkawalerk|\bstudio\b"),
    ("dom", r"(?iU)\bdom\b|\bdomu\b|\bbliźniak|\bszeregow"),
    ("dzialka", r"(?iU)\bdziałk|\bgrunt|\bteren inwestycyjn"),
    ("garaz", r"(?iU)\bgaraż|\bmiejsce postojow"),
    ("hala", r"(?iU)\bhala\b|\bmagazyn"),
    ("biuro", r"(?iU)\bbiur[oa]\b"),
    ("kamienica", r"(?iU)\bkamienic"),
    ("gospodarstwo", r"(?iU)\bgospodarstw|\brolne\b|\bsiedlisk"),
    ("lokal", r"(?iU)\blokal użytkow|\bhandlow|\busługow|\bbudynek użytkow|\bhotel|\bpensjonat|\brestauracyjn|\bgastronomiczn"),
    ("pokoj", r"(?iU)\bpokój do wynaj|\bpokoju do wynaj|\bstancj"),
)
TRANSACTION_HINTS = (
    ("wynajem", r"(?iu)wynaj|do wynaj|najem"),
    ("dzierzawa", r"(?iu)dzierżaw"),
    ("zamiana", r"(?iu)zamian"),
    ("sprzedaz", r"(?iu)sprzeda|na sprzedaż|licytacj|przetarg"),
)

# Who sells.
INSTITUTIONAL_SELLERS = ("komornik", "syndyk", "urzad", "instytucja")
INSTITUTION_HINTS = r"(?iU)komornik|syndyk|urząd|urzad|gmina|miasto|starostwo|skarb państwa|kowr|agencja mienia|zus\b|pkp\b|lasy państwowe|nadleśnictwo"
OFFICE_HINTS = r"(?iu)gmina|urz|starost|miasto"
DEVELOPER_HINTS = r"(?iu)deweloper|development|investment|inwestycje|budownictwo"
AGENCY_NAME = r"(?iU)nieruchomo|biuro nieruchomo|real estate|estate|kancelaria nieruchomo|agencja nieruchomo|\bsp\. z o\.o\.|\bs\.c\.\b|\bp\.h\.u\.|deweloper|invest|development|grupa |dom &|home\b|house\b|property|posrednictwo|pośrednictwo|licencja nr|\bpfrn\b|\bwspon\b"
AGENCY_DESCRIPTION = r"(?iu)prowizj|nasze biuro|zapraszamy do biura|licencja zawodowa"
PRIVATE_PHRASES = r"(?iu)bez pośredników|bezpośrednio od właściciela|oferta prywatna"
AGENCY_MATCH, AGENCY_CANDIDATES = 90, 300

# Maps and places.
POLAND = (48.9, 55.05, 13.9, 24.25)
JITTER_SPREAD, JITTER_ANGLE, JITTER_LON = 0.013, 137.508, 1.55
REVERSE_RADIUS_KM, STALE_POINT = 1.5, 0.002
SITEMAP_CHUNK, SITEMAP_LEAST = 20_000, 3

# Place names in text. Cues stand before a name, CUE_REACH characters at most; ambiguous names are common words.
PLACE_CUE = r"(?i)(?:w\s+miejscowo\w+|miejscowo\w+|we?\s+wsi|w\s+mie[śs]cie|sołectw\w+|obr[ęe]b\w*|po[łl]o[żz]on\w*\s+w|zlokalizowan\w*\s+w|adres\w*[:\s])\s*[:\-]?\s*"
COMMUNE_CUE = r"(?i)\bgm(?:\.|ina|iny|inie|inę)?\s+"
COUNTY_CUE = r"(?i)\bpow(?:\.|iat|iatu|iecie)?\s+"
CUE_REACH, EARLY, TOWN_RANK, VILLAGE_RANK, RANK_SHARE = 3, 60, 70, 30, 5
CUE_POINTS, COUNTY_POINTS, REGION_POINTS, EXACT_POINTS, EARLY_POINTS, REPEAT_POINTS = 60, 40, 25, 10, 5, 12
AMBIGUOUS_NAMES = (
    "Biała", "Biały Bór", "Boru", "Brzeziny", "Budy", "Czarna", "Czarne", "Dobra", "Dolina", "Dzielnica", "Góra", "Huta", "Kolonia", "Kąty",
    "Lipie", "Las", "Łąki", "Miasteczko", "Miejsce", "Most", "Mała", "Nowa", "Nowe", "Ogrody", "Osiedle", "Park", "Piaski", "Podlesie",
    "Pokój", "Przystań", "Rogi", "Ruda", "Rynek", "Sady", "Stara", "Stare", "Stawy", "Sucha", "Wielka", "Wola", "Zalesie", "Zamek",
)

# Ingestion and upkeep.
PRICE_CHANGE, MISSING_DAYS, MISSING_LIMIT, RETENTION_DAYS = 0.5, 3, 1000, 540
RATE_LIMIT, RATE_SECONDS = 60, 3600
PHONE_LIMIT, CONTACT_AGENCY_PHONES, CONTACT_TWINS = 10, 2, 8
ALERT_LIMIT = 50
MONTHS = {
    "stycznia": 1, "styczeń": 1,
    "lutego": 2, "luty": 2,
    "marca": 3, "marzec": 3,
    "kwietnia": 4, "kwiecień": 4,
    "maja": 5, "maj": 5,
    "czerwca": 6, "czerwiec": 6,
    "lipca": 7, "lipiec": 7,
    "sierpnia": 8, "sierpień": 8,
    "września": 9, "wrzesień": 9,
    "października": 10, "październik": 10,
    "listopada": 11, "listopad": 11,
    "grudnia": 12, "grudzień": 12,
}
WARSAW = "Europe/Warsaw"

# Titles on notice boards. What is an offer; what tells how one ended; forms to be filled in; what lists put before a title.
NOTICE_OFFER = r"(?iu)przetarg|nieruchomo|działk|dzialk|lokal|grunt|budynek|garaż|garaz|sprzeda|dzierżaw|dzierzaw|najem|najm|użytkowani|uzytkowani"
NOTICE_RESULT = r"(?iuU)rozstrzygni|wynik\w*\b|unieważni|uniewazni|odwoła|odwola|zakończeni|zakonczeni|nie doszedł|nie doszedl|protok[oó][łl]|lista os[oó]b|zakwalifikowan|sprostowani|informacja o zamiarze"
NOTICE_FORM = r"(?iuU)^(?:oświadczeni|oswiadczeni|formularz|regulamin|klauzul|wz[oó]r\b|druk\b|wniosek|zgłoszeni|zgloszeni|pełnomocnictw|pelnomocnictw|instrukcj)"
NOTICE_PREFIX = r"(?iu)^\s*(?:więcej|wiecej|czytaj więcej|zobacz)\s*[»>:]*\s*"
NOTICE_FILE = r"(?i)\.(pdf|docx?|odt|xlsx?|ods|zip|rtf|jpe?g|png|tiff?)(\?|$)"
NOTICE_LENGTH, NOTICE_DAYS = 20, 365
