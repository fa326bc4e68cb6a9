"""Recognizers of personal data, their policy, and the detection settings."""

from __future__ import annotations

from dataclasses import dataclass

# an area code in brackets, or a country code, perhaps a single digit, and eight digits or groups of two to four
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}[ .-]?(?:[0-9][ .-]?)?(?:[0-9]{8}|[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3})"
# Entity, score, pattern (Java syntax), in the order of detection.
PATTERNS = [
    ("STUDENT_NUMBER", 0.85, r"\b[0-9]{5,7}\b"),
    ("USERNAME", 0.9, r"@[\w]+"),
    ("USERNAME", 0.75, r"\b[\w]+(?:_[\w]+)+\b"),
    ("USERNAME", 0.75, r"\b[a-zA-Z][a-zA-Z0-9_]{1,25}\d{2,}[a-zA-Z0-9_]*\b"),
    ("OBFUSCATED_EMAIL", 0.85, r"[\w_]+(?:\s+(?:punt|\.)\s+[\w_]+)+\s+apenstaartje\s+[\w_]+(?:\s+(?:punt|\.)\s+[\w_]+)+"),
    ("BUILDING_OR_ROOM", 0.8, r"\b(?:R|TQ|TL|TX)\s*\d+(?:[.,]\d+)?\b"),
    ("BUILDING_OR_ROOM", 0.85, r"\b(?:lokaal|gebouw|ruimte)\s+\d+(?:[.,]\d+)?\b"),
    ("FLOOR_REFERENCE", 0.9, r"\b\d+[e]\s+etage\b"),
    ("FLOOR_REFERENCE", 0.9, r"\b(?:eerste|tweede|derde|vierde|vijfde|zesde|zevende|achtste|negende|tiende)\s+etage\b"),
    ("TEACHER_NAME_CONTEXT", 0.9, r"\b[A-Z][a-z]+(?:['’]s)?\b(?=\s+(?:grading|grades|feedback|assessment|assessments|marking|module|course|corrects))"),
    ("TEACHER_NAME_CONTEXT", 0.9, r"(?:(?<=[Dd]ocent )|(?<=[Tt]eacher )|(?<=[Pp]rofessor )|(?<=[Mm]entor ))[A-Z\u00C0-\u024F][A-Za-z\u00C0-\u024F]+(?:\s+[A-Z\u00C0-\u024F][A-Za-z\u00C0-\u024F]+)*(?:[‘’]s)?"),
    ("NL_BSN", 0.95, r"\b\d{3}\.\d{2}\.\d{3}\b"),
    ("NL_BSN", 0.75, r"\b\d{9}\b"),
    ("DUTCH_POSTCODE", 0.9, r"\b\d{4}\s?[A-Z]{2}\b"),
    ("DUTCH_PHONE", 0.9, r"\b06[-\s]\d{2}[-\s]?\d{2}[-\s]?\d{2}[-\s]?\d{2}\b"),
    ("DUTCH_PHONE", 0.95, r"(?<!\w)\+316\d{8}\b"),
    ("DUTCH_HONORIFIC", 0.9, r"\b(?:Mevrouw|mevrouw|Meneer|meneer|heer|Heer)\b|\b(?:Mevr|mevr|Dhr|dhr)\."),
    ("EMAIL_ADDRESS", 1.0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("PHONE_NUMBER", 0.75, PHONE),
]
#: what a text must hold for the pattern in the same place to match: any of some strings, or a simple pattern
NEEDED: list[list[str] | str] = [
    "[0-9]{5}", ["@"], ["_"], r"[0-9\p{Nd}]{2}", ["apenstaartje"], r"(?U)[RQLX]\s*\d", ["lokaal", "gebouw", "ruimte"], ["etage"], ["etage"],
    ["grad", "feedback", "assessment", "marking", "module", "course", "corrects"], ["ocent ", "eacher ", "rofessor ", "entor "],
    r"(?U)\d\.\d\d\.", r"(?U)\d{9}", r"(?U)\d{4}\s?[A-Z]", ["06"], ["+316"], ["evr", "eneer", "eer", "hr."], ["@"], ["+", "("],
]
TAGS = ["NAME", "PII", "LOCATION", "TITLE", "HEALTH"]
# Entity -> tag; entities that are not here are kept as they are.
POLICY = {
    "PERSON": "NAME", "TEACHER_NAME_CONTEXT": "NAME", "LOCATION": "LOCATION", "DUTCH_POSTCODE": "LOCATION", "DUTCH_HONORIFIC": "TITLE",
    "STUDENT_NUMBER": "PII", "USERNAME": "PII", "OBFUSCATED_EMAIL": "PII", "NL_BSN": "PII", "DUTCH_PHONE": "PII", "EMAIL_ADDRESS": "PII", "PHONE_NUMBER": "PII", "NRP": "PII",
}
# Surname particles, forms of address, and words that are no names.
PARTICLES = ["van den", "van der", "van de", "op den", "van", "de", "den", "der", "ten", "ter", "'t"]
NEVER_MASKED = ["meneer", "mevrouw"]
HONORIFICS = ["mevr.", "mevr", "dhr.", "dhr", "heer"]
ROLES = ["Docent ", "docent ", "Teacher ", "teacher ", "Professor ", "professor ", "Mentor ", "mentor "]
CARRY_STOP_WORDS = ["a", "an", "and", "are", "can", "could", "for", "from", "het", "how", "our", "the", "this", "too", "van", "wat", "we", "which", "with", "would", "you"]
NAME_STOP_WORDS = [*CARRY_STOP_WORDS, "course", "feedback", "module", "timely"]
NAME_TOKENS = r"^[A-Z\u00C0-\u024F][A-Za-z\u00C0-\u024F]+(?:\s+(?:de|den|der|van|von|of|[A-Z\u00C0-\u024F][A-Za-z\u00C0-\u024F]+))*$"
LABEL_TAGS = [
    ("NAME", ["NAME", "PERSON", "FIRSTNAME", "LASTNAME", "SURNAME", "GIVENNAME"]),
    ("LOCATION", ["CITY", "ADDRESS", "STREET", "LOCATION", "ZIPCODE", "POSTAL", "STATE", "COUNTRY", "REGION"]),
    ("HEALTH", ["HEALTH", "MEDICAL", "CONDITION", "DIAGNOSIS", "ILLNESS", "DISEASE", "DISABILITY", "MEDICATION"]),
]


@dataclass(frozen=True)
class Toggles:
    """What is masked, and the least scores."""

    names: bool = True
    locations: bool = True
    pii: bool = True
    titles: bool = True
    min_score: float = 0.6
    min_detection_score: float = 0.85

    def tag_of(self, entity: str) -> str | None:
        tag = POLICY.get(entity)
        return tag if tag and self.allows(tag) else None

    def allows(self, tag: str) -> bool:
        return {"NAME": self.names, "LOCATION": self.locations, "PII": self.pii, "HEALTH": self.pii, "TITLE": self.titles}.get(tag, True)
