"""Phrases and patterns that decide meaning. Lists that have to be as they are for right results are marked fixed."""

from __future__ import annotations

import re

# Phrases by which an answer says that nothing is available.
UNAVAILABLE_ANSWER = (
    "n'est pas disponible", "ne sont pas disponibles", "pas disponible dans les documents", "n'est pas présente",
    "n'est pas mentionné", "n'est pas mentionnée", "ne mentionne pas", "ne mentionnent pas",
    "ne contient aucune information", "ne contiennent aucune information", "sans aucune référence",
    "aucune source pertinente", "aucune information", "غير متوفر", "غير متوفرة", "لا توجد معلومات", "لا توجد ذكر",
    "لا يحتوي", "لا تحتوي", "لا يتحدث", "لا يحدد", "not available", "not found in the provided documents", "does not contain",
)
# What is answered then.
UNAVAILABLE_MESSAGE = {
    "fr": "L'information n'est pas disponible dans les documents fournis.",
    "ar": "المعلومة غير متوفرة في الوثائق المقدمة.",
}
# The phrases that evaluation takes for missing information.
UNAVAILABLE = (
    "غير متوفر", "غير متوفرة", "لا تتوفر", "المعلومة غير متوفرة", "لا توجد معلومات", "لا يوجد ذكر", "لا يحتوي", "لا تحتوي",
    "n'est pas disponible", "ne sont pas disponibles", "pas disponible", "non disponible",
    "les documents ne contiennent pas", "ne mentionne pas", "ne mentionnent pas", "sans aucune référence",
    "aucune information", "not available", "not found", "not mentioned", "does not contain",
)
# Phrases of a negative decision; those for missing information are negative too.
NEGATIVE = (
    *UNAVAILABLE,
    "لا يوجد", "لا توجد", "غير موجود", "غير موجودة", "ليست موجودة", "لا يجب", "غير مطلوب", "لا تخضع", "ليس", "ليست", "لا",
    "non", "n'existe pas", "ne contient pas", "ne contiennent pas", "pas mentionné", "pas mentionnée", "pas exigé",
    "pas exigée", "no", "does not exist", "do not", "doesn't", "isn't",
)
# Phrases of a positive decision.
POSITIVE = (
    "نعم", "يوجد", "توجد", "موجود", "موجودة", "مذكور", "مذكورة", "متوفر", "متوفرة", "oui", "disponible", "existe",
    "mentionné", "mentionnée", "yes", "found", "mentioned", "available",
)
# What contradicts a leading no, and the words that lead.
STRONG_POSITIVE = frozenset(("نعم", "يوجد", "توجد", "موجود", "موجودة", "oui", "yes", "existe", "found"))
LEADING_YES, LEADING_NO = frozenset(("نعم", "oui", "yes")), frozenset(("لا", "non", "no"))
# Messages that ask for more, in the follow-up form.
FOLLOW_UPS = (
    "اشرح ذلك", "اشرح اكثر", "وضح ذلك", "وضح اكثر", "ماذا يعني ذلك", "هل يمكنك التوضيح", "اعطني تفاصيل اكثر",
    "مزيد من التفاصيل", "وماذا ايضا", "و ماذا ايضا", "كيف ذلك", "لماذا", "explique cela", "explique davantage",
    "qu'est-ce que cela signifie", "donne plus de details", "donnez plus de details", "plus de details", "pourquoi",
    "comment ca", "et aussi",
)
SINGLE_FOLLOW_UPS = ("لماذا", "pourquoi")
# Words that are no evidence.
EVIDENCE_STOPWORDS = (
    "avec", "dans", "des", "est", "les", "pour", "que", "quel", "quelle", "sont", "une", "the", "what", "which",
    "التي", "الذي", "في", "من", "ما", "ماذا", "هل", "هي", "هو",
)
# Patterns in Java's syntax for lines of reasoning, references in chats, and the numbers that route a search.
REASONING_LINE = (
    r"(?i)^(?:okay|ok|hmm|wait|let['’]s\s+(?:tackle|analy[sz]e|think)|i\s+(?:need|have|should|will)\s+to|we\s+need\s+to|"
    r"the user (?:is asking|asks)|je dois|voyons|analysons|حسن[ًاا]|دعني|أحتاج)"
)
CHAT_REFERENCE = (
    r"(?i)(?:\b\d{1,4}[_/-]\d{4}\b|(?:texte|document|note|circulaire)\s*(?:n[°o]?|num[eé]ro)?\s*\d{1,4}|"
    r"(?:النص|الوثيقة|المذكرة|المنشور)\s*(?:عدد|رقم)?\s*\d{1,4})"
)
# Number and year, most specific first.
ROUTES = (
    r"(?<!\d)(\d{1,4})\s*[_-]\s*(\d{4})(?!\d)",
    r"(?:النص|للنص|الوثيقة|القرار)\s*(?:عدد|رقم)?\s*(\d{1,4})(?:\s*(?:لسنة|سنة)\s*(\d{4}))?",
    r"(?i)(?:texte|document)\s*(?:n(?:o|°)?|num(?:e|é)ro)?\s*(\d{1,4})(?:\s*(?:de|/)\s*(\d{4}))?",
    r"(?<!\d)(\d{1,4})\s*(?:لسنة|سنة)\s*(\d{4})(?!\d)",
)
# Patterns in Python's syntax for number and year of a document.
REFERENCES = tuple(
    re.compile(p)
    for p in (
        r"(?<![\d_/-])(\d{1,4})\s*[_/-]\s*((?:19|20)\d{2})(?![\d_/-])",
        r"(?:النص|الوثيقة|القرار|المذكرة|المنشور)?\s*(?:عدد|رقم)\s*[:#-]?\s*(\d{1,4})\s*(?:لسنة|سنة)\s*((?:19|20)\d{2})",
        r"(?i)(?:document|texte|décret|decret|arrêté|arrete|note|circulaire)\s*(?:n(?:°|º|o)?|numéro|numero)?\s*[:#-]?\s*"
        r"(\d{1,4})\s*(?:de|du|[_/-])\s*((?:19|20)\d{2})",
        r"(?i)(?:n(?:°|º|o)?|numéro|numero)\s*[:#-]?\s*(\d{1,4})\s*(?:de|du|[_/-])\s*((?:19|20)\d{2})",
    )
)
# Header cells of catalogue tables by field, and labels of links that say nothing.
HEADERS = {
    "document_number": ("رقم النص", "رقم الوثيقة", "numero du texte", "numero du document", "document number", "number"),
    "date": ("التاريخ", "date"),
    "title": ("الموضوع", "العنوان", "sujet", "objet", "titre", "subject", "title"),
}
GENERIC_LABELS = frozenset(("", "download", "pdf", "télécharger", "تحميل", "تنزيل"))
