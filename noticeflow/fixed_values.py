"""Fixed values.

FIXED VALUES -- these must equal the behaviour being reproduced, so they are
stated here plainly, in their natural order, in one place.  Nothing else in the
package hard-codes a name, a host or a rule string.
"""

# ---------------------------------------------------------------- FIXED VALUES
# The 16 districts of the province, in declared order (order decides
# first-match district detection and section order).
DISTRICTS = (
    "MALA",
    "ASIA",
    "SAN VICENTE DE CAÑETE",
    "CHILCA",
    "SAN ANTONIO",
    "CALANGO",
    "CERRO AZUL",
    "COAYLLO",
    "IMPERIAL",
    "LUNAHUANÁ",
    "NUEVO IMPERIAL",
    "PACARÁN",
    "QUILMANÁ",
    "SAN LUIS",
    "SANTA CRUZ DE FLORES",
    "ZÚÑIGA",
)

# Display names of ambiguous districts, per portal (everything else: Title Case).
PLACE_NAMES_INDEED = {
    "SAN LUIS": "San Luis de Cañete",
    "SAN ANTONIO": "San Antonio de Cañete",
}
PLACE_NAMES_BUMERAN = {
    "SAN VICENTE DE CAÑETE": "San Vicente de Cañete",
    "SAN LUIS": "San Luis de Cañete",
    "SAN ANTONIO": "San Antonio de Cañete",
}
SLUGS_BUMERAN = {
    "SAN VICENTE DE CAÑETE": "san-vicente-de-canete",
    "SAN LUIS": "san-luis-de-canete",
    "SAN ANTONIO": "san-antonio-de-canete",
}
PLACE_NAMES_LINKEDIN = {
    "SAN VICENTE DE CAÑETE": "San Vicente de Cañete",
    "SAN LUIS": "San Luis de Cañete",
    "SAN ANTONIO": "San Antonio de Cañete",
}
# Computrabajo zones needing the province name somewhere in the card.
AMBIGUOUS_ZONES = ("san luis", "san antonio")
PROVINCE_WORD = "cañete"

# Source registry: name, declared order, host, reference prefix, cards per page.
SOURCE_COMPUTRABAJO = "Computrabajo Perú"
SOURCE_INDEED = "Indeed Perú"
SOURCE_LINKEDIN = "LinkedIn"
SOURCE_BUMERAN = "Bumeran Perú"
SOURCE_OFFICIAL = "SERVIR - Talento Perú"
PORTAL_SOURCES = (SOURCE_COMPUTRABAJO, SOURCE_INDEED, SOURCE_LINKEDIN, SOURCE_BUMERAN)

BASE_COMPUTRABAJO = "https://pe.computrabajo.com"
BASE_INDEED = "https://pe.indeed.com"
BASE_LINKEDIN = "https://pe.linkedin.com"
BASE_BUMERAN = "https://www.bumeran.com.pe"
HOST_COMPUTRABAJO = "pe.computrabajo.com"
HOST_INDEED = "pe.indeed.com"
HOST_LINKEDIN = "pe.linkedin.com"
HOST_BUMERAN = "www.bumeran.com.pe"

# Search addresses.
SEED_PATH_COMPUTRABAJO = "/empleos-en-lima-en-"
SEED_PATH_LINKEDIN = ("/jobs/search?keywords=&location=Provincia%20de%20Ca%C3%B1ete%2C%20Lima%2C%20Per%C3%BA"
                      "&geoId=106443255&position=1&pageNum=0")

PREFIX_COMPUTRABAJO = "CT"
PREFIX_INDEED = "IN"
PREFIX_LINKEDIN = "LI"
PREFIX_BUMERAN = "BU"

LIMIT_COMPUTRABAJO = 12
LIMIT_INDEED = 10
LIMIT_LINKEDIN = 100
LIMIT_BUMERAN = 10

# Official portal page used when a listing carries no URL of its own.
OFFICIAL_URL = "https://app.servir.gob.pe/DifusionOfertasExterno/faces/consultas/ofertas_laborales.xhtml"
OFFICIAL_HOST_SUFFIX = "servir.gob.pe"  # link harvesting skips hosts ending with this (no dot)

# Card defaults.
DEFAULT_DEPARTMENT = "LIMA"
DEFAULT_PROVINCE = "CAÑETE"
DEFAULT_VACANCIES = "1"
DEFAULT_COMPANY = "Empresa no especificada"
DEFAULT_SALARY = "No especificado"
DEFAULT_AGE = "Publicado recientemente"
DEFAULT_REGION_LABEL = "Sin región especificada"
DEFAULT_SOURCE_BADGE = "Fuente original"
DEFAULT_DOC_TITLE = "Descargar bases o anexo oficial"
SALARY_MARK = "S/."

# Freshness window in days.
MAX_AGE_DAYS = 7
# Publication queue size.
PUBLISH_LIMIT = 20

# Relative-age vocabulary (applied to the accent-free, case-folded text).
AGE_NONE_WORDS = ("mas de",)
AGE_ZERO_WORDS = ("hoy", "minuto", "hora", "recien")
AGE_ONE_WORD = "ayer"
AGE_DAYS_PATTERN = r"hace\s+(\d+)\s+dias?"
AGE_WEEKS_PATTERN = r"hace\s+(\d+)\s+semanas?"
# Bumeran age phrase inside the card text.
BUMERAN_AGE_PATTERN = (
    r"(?:publicado|actualizado)\s+(?:hoy|ayer|hace\s+(?:\d+\s+)?"
    r"(?:minutos?|horas?|d[ií]as?|semanas?|mes(?:es)?))"
)
BUMERAN_CARD_PATTERN = r"(publicado|actualizado)\s+(hoy|ayer|hace)"
BUMERAN_CARD_MAX_CHARS = 3500

# Direct-application links: blocked host, blocked (host, path) pairs.
BLOCKED_DIRECT_HOSTS = ("share.google",)
BLOCKED_DIRECT_PAIRS = (
    ("unajma.edu.pe", "/convocatoria-personal"),
    ("www.gob.pe", "/muniandresavelinocaceresdorregaray"),
)
# Official domains, and application domains that are never valid.
OFFICIAL_DOMAINS = ("gob.pe",)
BLOCKED_APPLICATION_DOMAINS = (
    "convocatoriasdetrabajo.com",
    "perutrabajos.com",
    "empleosperu.gob.pe.fake",
)

# Required listing fields (audit).
REQUIRED_FIELDS = (
    "titulo",
    "entidad",
    "ubicacion",
    "numero_convocatoria",
    "vacantes",
    "fecha_inicio",
    "fecha_fin",
    "url_oficial",
)

# Columns carried forward from the previous version of a listing when absent.
CARRIED_COLUMNS = (
    "archivo_oficial",
    "url_postulacion",
    "url_consulta",
    "requerimiento",
    "experiencia",
    "formacion_academica",
    "especializacion",
    "conocimiento",
    "competencias",
    "detalle_entidad",
    "enlaces_bases",
)

# Detail sections: field, opening header, closing header.
DETAIL_SECTIONS = (
    ("requerimiento", "REQUERIMIENTO:", "EXPERIENCIA:"),
    ("experiencia", "EXPERIENCIA:", "FORMACIÓN ACADÉMICA - PERFIL:"),
    ("formacion_academica", "FORMACIÓN ACADÉMICA - PERFIL:", "ESPECIALIZACIÓN:"),
    ("especializacion", "ESPECIALIZACIÓN:", "CONOCIMIENTO:"),
    ("conocimiento", "CONOCIMIENTO:", "COMPETENCIAS:"),
    ("competencias", "COMPETENCIAS:", "DETALLE:"),
    ("detalle_entidad", "DETALLE:", "CANTIDAD DE VACANTES:"),
)
NOT_APPLICABLE = "NO APLICA"

# Requirement labels of the detail view, in display order.
DETAIL_LABELS = (
    ("Requerimiento", "requerimiento"),
    ("Experiencia", "experiencia"),
    ("Formación académica", "formacion_academica"),
    ("Especialización", "especializacion"),
    ("Conocimientos", "conocimiento"),
    ("Competencias", "competencias"),
    ("Detalle publicado por la entidad", "detalle_entidad"),
)
CERTIFICATE_NOTICE_LINK = "share.google/IovzweaQemtlVGF9i"

# Plain-text record layout of the official portal.
TEXT_RECORD_MARKER = r"Ubicación:\s*"
TEXT_FIELDS = (
    ("ubicacion", r"^(.*?)Número de Convocatoria"),
    ("numero_convocatoria", r"Número de Convocatoria:\s*(.*?)Cantidad de Vacantes"),
    ("vacantes", r"Cantidad de Vacantes:\s*(.*?)Remuneración"),
    ("remuneracion", r"Remuneración:\s*(.*?)Fecha Inicio"),
)
TEXT_START_DATE = r"Publicación:\s*(\d{2}/\d{2}/\d{4})"
TEXT_END_DATE = r"Fecha Fin de Publicación:\s*(\d{2}/\d{2}/\d{4})"
SERVICE_CODE_PATTERN = r"\bN[°º]\s*(\d{4,})\b"
PAGE_COUNTER_PATTERN = r"Página\s+(\d+)\s+de\s+(\d+)"

# Document-like links.
DOC_EXTENSION_PATTERN = r"\.(pdf|doc|docx|xls|xlsx)(?:$|[?#])"
DOC_WORDS = ("base", "anexo", "cronograma")
ZIP_MAGIC_HEX = "504B0304"

# Page-block words (the page says it refused an automated visit).
BLOCK_WORDS = ("captcha", "robot")

# Generated-file content that must not appear (audit), two messages.
FORBIDDEN_WORD_DOC = ("../documentos_oficiales/", "Talento Perú (Word)")
FORBIDDEN_GENERAL_LIST = ('class="btn-fuente"', "Ver esta convocatoria en SERVIR")

# Publication message.
MESSAGE_HEADER = "📢 NUEVA CONVOCATORIA"
MESSAGE_TAGS = "#TrabajoPeru #Convocatoria #EmpleoPublico"
# ------------------------------------------------------------ END FIXED VALUES
