"""Fixed vocabularies and parameters of the domain.

Everything below the "Fixed values" headings is a given constant: labels, word lists,
thresholds and tables whose values define the result. No logic lives here.
"""

from __future__ import annotations

# --- Fixed values: label domains -------------------------------------------------------------

EVENT_TYPES = (
    "resultados_empresariales", "guidance_profit_warning", "regulacion", "litigio",
    "fusion_adquisicion", "ciberincidente", "incidencia_operativa", "macroeconomia",
    "cadena_suministro", "cambio_directivo", "dividendo_recompra", "otro",
)
DIRECTIONS = ("alcista", "bajista", "neutral")
SEVERITY_LEVELS = ("muy_baja", "baja", "media", "alta", "muy_alta")
ENTITY_LABELS = ("ORG", "PERSON", "GPE", "NORP", "MONEY", "PERCENT", "DATE", "LAW")

# --- Fixed values: thresholds ----------------------------------------------------------------

RELEVANCE_PASS = 0.5
RELEVANCE_BORDERLINE = 0.3
SEVERITY_MIN = 0.3
DEDUP_SIMILARITY = 0.85
ALERTS_PER_HOUR = 20
RETENTION_DAYS = 30
HISTORY_STORE = 500
HISTORY_MEMORY = 200
DIRECTION_CUT = 0.15
MERGE_SEVERITY_BAND = 0.2
MERGE_DIRECTION_CONFIDENCE = 0.6
NEUTRAL_BAND = 0.005
ESTIMATION_WINDOW = (-120, -11)
EVENT_WINDOWS = ((-1, 1), (-1, 3), (-1, 5))
MIN_ESTIMATION_DAYS = 30
SIGNIFICANT_T = 1.96
MIN_CALIBRATION_PAIRS = 15
TRADING_DAYS = 252

# --- Fixed values: word lists ----------------------------------------------------------------

CORPORATE_SUFFIXES = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc",
    "lp", "llp", "plc", "ag", "nv", "sa", "sas", "spa", "srl", "gmbh", "kg", "ab", "oyj",
    "asa", "as", "bv", "se", "pte", "pty", "holdings", "holding", "group", "grp", "the", "class",
)
SHORT_COMMON_WORDS = (
    "a", "an", "it", "ai", "us", "or", "all", "on", "at", "am", "be", "do", "go", "no", "so",
)
SPANISH_STOP_WORDS = ("de", "la", "el", "en", "que", "los", "las", "del", "por", "una", "con")
ORG_STOP_FIRST_WORDS = (
    "The", "This", "That", "These", "Those", "Monday", "Tuesday", "Wednesday", "Thursday",
    "Friday", "Saturday", "Sunday",
)

# Event keyword lists, in priority order (an earlier event wins a tie).
EVENT_KEYWORDS = {
    "resultados_empresariales": ("earnings", "revenue", "profit", "quarterly results", "eps", "resultados", "beneficio"),
    "guidance_profit_warning": ("guidance", "outlook", "profit warning", "downgrade", "forecast"),
    "regulacion": ("regulatory", "regulation", "fine", "sanction", "compliance", "regulación", "sanción", "multa"),
    "litigio": ("lawsuit", "litigation", "court", "settlement", "investigation", "demanda", "litigio"),
    "fusion_adquisicion": ("merger", "acquisition", "takeover", "buyout", "deal", "fusión", "adquisición", "opa"),
    "ciberincidente": ("cyber", "breach", "hack", "ransomware", "data leak", "ciberataque"),
    "incidencia_operativa": ("outage", "recall", "failure", "disruption", "operational"),
    "macroeconomia": ("interest rate", "inflation", "gdp", "central bank", "fed", "bce", "tipos de interés"),
    "cadena_suministro": ("supply chain", "logistics", "shipping", "shortage", "cadena de suministro"),
    "cambio_directivo": ("ceo", "board", "executive", "appointed", "resign", "consejero", "directivo"),
    "dividendo_recompra": ("dividend", "buyback", "share repurchase", "dividendo", "recompra"),
}

# --- Fixed values: impact priors (event type: base severity, direction bias) -------------------

IMPACT_PRIORS = {
    "resultados_empresariales": (0.6, 0.0),
    "guidance_profit_warning": (0.75, -0.3),
    "regulacion": (0.65, -0.2),
    "litigio": (0.7, -0.4),
    "fusion_adquisicion": (0.7, 0.1),
    "ciberincidente": (0.8, -0.5),
    "incidencia_operativa": (0.6, -0.3),
    "macroeconomia": (0.5, 0.0),
    "cadena_suministro": (0.6, -0.2),
    "cambio_directivo": (0.5, 0.0),
    "dividendo_recompra": (0.4, 0.3),
    "otro": (0.3, 0.0),
}

# Severity score thresholds and |CAR| bands (label: lower, upper), ascending.
SEVERITY_SCORE_CUTS = (("muy_alta", 0.8), ("alta", 0.6), ("media", 0.4), ("baja", 0.2))
ABS_CAR_BANDS = (
    ("muy_baja", 0.0, 0.005),
    ("baja", 0.005, 0.015),
    ("media", 0.015, 0.03),
    ("alta", 0.03, 0.06),
    ("muy_alta", 0.06, 1.0),
)
TOP_BAND_CAP = 0.12

# --- Fixed values: display texts --------------------------------------------------------------

EVENT_TEXT = {
    "resultados_empresariales": "Resultados empresariales",
    "guidance_profit_warning": "Revisión de guidance / profit warning",
    "regulacion": "Acción regulatoria",
    "litigio": "Litigio / procedimiento legal",
    "fusion_adquisicion": "Fusión o adquisición",
    "ciberincidente": "Ciberincidente",
    "incidencia_operativa": "Incidencia operativa",
    "macroeconomia": "Evento macroeconómico",
    "cadena_suministro": "Cadena de suministro",
    "cambio_directivo": "Cambio directivo",
    "dividendo_recompra": "Dividendo / recompra de acciones",
    "otro": "Otro evento",
}
SEVERITY_ICON = {"muy_alta": "🔴", "alta": "🟠", "media": "🟡", "baja": "🟢", "muy_baja": "⚪"}
DEFAULT_ICON = "🔔"

# --- Fixed values: sector and region names ------------------------------------------------------

SECTOR_NAMES = {
    "technology": "Technology", "tech": "Technology", "information technology": "Technology",
    "healthcare": "Healthcare", "health care": "Healthcare",
    "financial services": "Financial Services", "financials": "Financial Services",
    "consumer cyclical": "Consumer Cyclical", "consumer discretionary": "Consumer Cyclical",
    "consumer defensive": "Consumer Defensive", "consumer staples": "Consumer Defensive",
    "energy": "Energy", "industrials": "Industrials", "real estate": "Real Estate",
    "utilities": "Utilities", "communication services": "Communication Services",
    "basic materials": "Basic Materials", "materials": "Basic Materials",
}
REGION_COUNTRIES = {
    "United States": ("united states", "usa", "us", "united states of america"),
    "Europe": ("spain", "germany", "france", "united kingdom", "uk", "italy", "netherlands",
               "switzerland", "sweden", "ireland", "belgium", "portugal", "austria", "norway",
               "denmark", "finland"),
    "Asia": ("japan", "south korea", "singapore", "hong kong", "taiwan"),
    "Emerging Markets": ("china", "india", "brazil", "mexico", "indonesia", "thailand",
                         "south africa", "turkey", "russia", "argentina", "chile", "colombia"),
}

# --- Fixed values: ideal allocations and minimum holdings by risk profile ------------------------

IDEAL_SECTORS = {
    "muy_conservador": {"Utilities": 20, "Financial Services": 20, "Healthcare": 15, "Consumer Defensive": 15,
                        "Real Estate": 10, "Industrials": 10, "Technology": 5, "Other": 5},
    "conservador": {"Utilities": 15, "Financial Services": 18, "Healthcare": 15, "Consumer Defensive": 12,
                    "Real Estate": 10, "Industrials": 10, "Technology": 12, "Other": 8},
    "moderado": {"Technology": 20, "Healthcare": 15, "Financial Services": 15, "Industrials": 12,
                 "Consumer Cyclical": 10, "Consumer Defensive": 8, "Energy": 8, "Real Estate": 7, "Other": 5},
    "agresivo": {"Technology": 30, "Healthcare": 15, "Consumer Cyclical": 12, "Financial Services": 10,
                 "Energy": 10, "Industrials": 8, "Communication Services": 8, "Other": 7},
    "muy_agresivo": {"Technology": 40, "Consumer Cyclical": 15, "Healthcare": 12, "Communication Services": 10,
                     "Energy": 8, "Financial Services": 8, "Other": 7},
}
IDEAL_REGIONS = {
    "muy_conservador": {"United States": 40, "Europe": 30, "Asia": 15, "Other": 15},
    "conservador": {"United States": 45, "Europe": 25, "Asia": 18, "Other": 12},
    "moderado": {"United States": 50, "Europe": 22, "Asia": 18, "Other": 10},
    "agresivo": {"United States": 50, "Europe": 18, "Asia": 20, "Emerging Markets": 7, "Other": 5},
    "muy_agresivo": {"United States": 45, "Asia": 25, "Europe": 15, "Emerging Markets": 10, "Other": 5},
}
MIN_HOLDINGS = {"muy_conservador": 10, "conservador": 8, "moderado": 6, "agresivo": 5, "muy_agresivo": 4}
DEFAULT_PROFILE = "moderado"

# --- Fixed values: questionnaire (question: weight, option scores) --------------------------------

RISK_QUESTIONS = {
    "q1_horizon": (1.5, {"q1_a": 5, "q1_b": 20, "q1_c": 50, "q1_d": 75, "q1_e": 95}),
    "q2_goal": (1.2, {"q2_a": 10, "q2_b": 30, "q2_c": 55, "q2_d": 80, "q2_e": 95}),
    "q3_loss_reaction": (2.0, {"q3_a": 5, "q3_b": 25, "q3_c": 55, "q3_d": 80, "q3_e": 95}),
    "q4_knowledge": (0.8, {"q4_a": 10, "q4_b": 30, "q4_c": 55, "q4_d": 80, "q4_e": 95}),
    "q5_experience": (0.8, {"q5_a": 5, "q5_b": 25, "q5_c": 50, "q5_d": 75, "q5_e": 95}),
    "q6_income_stability": (1.0, {"q6_a": 10, "q6_b": 30, "q6_c": 45, "q6_d": 70, "q6_e": 90}),
    "q7_liquidity": (1.2, {"q7_a": 5, "q7_b": 25, "q7_c": 50, "q7_d": 75, "q7_e": 95}),
    "q8_max_loss": (1.5, {"q8_a": 5, "q8_b": 20, "q8_c": 45, "q8_d": 75, "q8_e": 95}),
}
RISK_BANDS = ((20, "muy_conservador"), (40, "conservador"), (60, "moderado"), (80, "agresivo"))
TOP_RISK_BAND = "muy_agresivo"
DEFAULT_RISK_SCORE = 50
HORIZON_BY_OPTION = {"q1_a": "corto_plazo", "q1_b": "corto_plazo", "q1_c": "medio_plazo",
                     "q1_d": "largo_plazo", "q1_e": "largo_plazo"}
GOAL_BY_OPTION = {"q2_a": "preservacion_capital", "q2_b": "generacion_rentas", "q2_c": "crecimiento_equilibrado",
                  "q2_d": "crecimiento_agresivo", "q2_e": "especulacion"}
KNOWLEDGE_BY_OPTION = {"q4_a": "principiante", "q4_b": "principiante", "q4_c": "intermedio",
                       "q4_d": "avanzado", "q4_e": "experto"}
LOSS_BY_OPTION = {"q8_a": 0.0, "q8_b": 5.0, "q8_c": 15.0, "q8_d": 30.0, "q8_e": 50.0}
ESG_OPTIONS = ("q9_a", "q9_b")
SECTOR_BY_OPTION = {"q10_a": "Technology", "q10_b": "Healthcare", "q10_c": "Energy", "q10_d": "Financial Services",
                    "q10_e": "Consumer Cyclical", "q10_f": "Real Estate", "q10_g": "Utilities"}

# --- Fixed values: agreement bands (upper bound inclusive: label) ----------------------------------

KAPPA_BANDS = ((0.2, "leve"), (0.4, "aceptable"), (0.6, "moderado"), (0.8, "sustancial"))
KAPPA_POOR = "pobre"
KAPPA_TOP = "casi_perfecto"

# Message texts of recommendations; {0} to {3} are the columns named in the rule.
RECOMMENDATION_TEXTS = {
    "sector_over": "El sector {0} está sobreexpuesto en tu cartera ({1}% actual vs {2}% ideal para perfil {3}). Reducir ayuda a equilibrar.",
    "sector_under": "El sector {0} está infraexpuesto en tu cartera ({1}% actual vs {2}% ideal). Incorporar exposición mejora la diversificación.",
    "position_cap": "{0} representa el {1}% de la cartera. Ningún activo debería superar el 15-20% para un perfil {3}.",
    "region_under": "Tu cartera tiene solo {1}% en {0} vs {2}% ideal. Añadir exposición internacional reduce el riesgo país.",
    "hold": "Tu cartera está razonablemente alineada con tu perfil de riesgo. Mantén la estrategia actual y revisa periódicamente.",
}

# Message texts of portfolio warnings; {0} and {1} are the columns named in the rule.
WARNING_TEXTS = {
    "few_assets": "Tu cartera tiene {0} activos. Para tu perfil ({1}) se recomiendan al menos {2}.",
    "concentration": "Alta concentración: {0} representa el {1}% de la cartera. Considera diversificar.",
    "over_sectors": "Sobreexposición significativa en: {0}. Esto aumenta el riesgo sectorial.",
    "under_sectors": "Infrarrepresentación significativa en: {0}. Podrías estar perdiéndote oportunidades de diversificación.",
    "single_region": "Toda tu cartera está concentrada en una sola región geográfica. La diversificación geográfica reduce el riesgo país.",
}

# Message texts of alerts.
EXPLANATION_TEXTS = {
    "alert": "Posible alerta {0} de severidad {1} para {2}.",
    "event": "Evento detectado: {0}.",
    "relevance": "Relevancia: {0}.",
    "confidence": "Confianza: {0}.",
    "source": "Fuente: {0}.",
    "supplied": "{0}. Confianza: {1}. Fuente: {2}.",
    "no_assets": "cartera general",
    "direct": "mención directa de activo en cartera",
    "semantic": "alta similitud semántica con la cartera",
    "indirect": "relevancia indirecta por sector o geografía",
    "mood": "sentimiento {0} detectado por FinBERT",
}
SUBJECT_TEXT, SUBJECT_NO_ASSETS = "{0} Alerta {1} ({2}) — {3}", "cartera"
BODY_LINES = (
    "ALERTA: {0}", "", "Dirección: {1}", "Severidad: {2} ({3})", "Confianza: {4}", "Activos: {5}", "Evento: {6}", "Sentimiento: {7}", "",
    "Explicación: {8}", "", "Fuente: {9}", "URL: {10}",
)
