"""Column names, labels and lookup lists shared by the whole package."""

from __future__ import annotations

WAVE = "wave"
SUBJECT = "msisdn"
ACCOUNT = "cuenta_id"
TOUCH_DATE = "fecha_envio"
CHANNEL = "canal"
STEP = "canvas_step_nm"
VARIATION = "canvas_variation_nm"
CAMPAIGN = "campaign_id"
CONV_DATE = "fecha_conv"

#: Attributes that only exist on the conversion record, in output order.
CONVERSION_ATTRS = ("canal_venta", "ciudad", "departamento", "plan_nm", "plan_detalle")
#: Attributes of the winning touch, in tie-break order after the priority.
TOUCH_ATTRS = (CHANNEL, STEP, VARIATION, ACCOUNT)

# Labels that appear verbatim in the published report files.
NO_STEP = "(sin paso)"
NO_VARIATION = "(sin variante)"
NO_DATA = "SIN DATO"
ROUTE_PREFIX = "Ruta "
ROUTE_SEPARATOR = " > "
NO_EXCLUSIVE_STEPS = "sin pasos exclusivos"
EXCLUSIVE_SEPARATOR = " y "
MATCH_BOTH = "AMBAS"
MATCH_ONLY = "SOLO "
MATCH_NONE = "NINGUNA"

# Who wins when several channels reach a subject on one day.
CHANNEL_PRIORITY = {"push": 1, "sms": 2, "whatsapp": 3, "email": 4, "inapp": 5}
CHANNEL_PRIORITY_FIRST_VERSION = {"whatsapp": 1, "sms": 2, "push": 3, "email": 4, "inapp": 5}
DEFAULT_PRIORITY = 99

# Weekday names, Monday first (report spelling and calendar spelling).
WEEKDAYS = ("Lunes", "Martes", "Miercoles", "Jueves", "Viernes", "Sabado", "Domingo")
WEEKDAYS_ACCENTED = ("Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo")

# Report defaults.
LAST_TOUCH_DAYS = 7
MIN_SUPPORT = 3
SUPPORT_FALLBACK = 10
TOP_CATEGORIES = 8
SAMPLE_SIZE = 50
EARLY_DAYS = 3
