"""Ranked tiers of the seven head values, as data.

A tier names where it looks (scope), the documents it holds for (roles), what the line says (pattern; its first group is the
value) and what the lines above and below must say. The first tier with a value decides; the order of the lists is the rank.
Patterns are our own readings of the tiers' descriptions; they read lines, not layout, so tiers that need boxes or tables use
the line above or below instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatherum.functions.dates import find_dates
from gatherum.operators.readers import Tier, register_mark, register_refusals, register_tiers

# Words of instruments, answers, bodies, months and roles in three languages.
TYPE = r"(?:motion|postulat|interpellation|(?:schriftliche |kleine |dringliche )?anfrage|auftrag|question|parlamentarische initiative|initiative parlementaire|iniziativa parlamentare|mozione|postulato|interpellanza|interrogazione)"
ANSWER = r"(?:beantwortung|antwort|stellungnahme|r[ée]ponse|risposta|presa di posizione)"
BODY = r"(?:regierungsrat|gemeinderat|stadtrat|bundesrat|staatsrat|conseil d.[ée]tat|conseil municipal|conseil f[ée]d[ée]ral|consiglio di stato|municipio|consiglio federale)"
COUNCIL = r"(?:GR|GGR|GRG|KR|ER|LR)"
MONTH = r"(?iu:januar|februar|m[äa]rz|april|mai|juni|juli|august|september|oktober|november|dezember|janvier|f[ée]vrier|mars|avril|juin|juillet|ao[uû]t|septembre|octobre|novembre|d[ée]cembre|gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|dicembre)"
DAY = rf"(\d{{1,2}}[./]\s?\d{{1,2}}[./]\s?(?:\d{{4}}|\d{{2}})|\d{{1,2}}(?:\.|er)?\s{MONTH}\s\d{{4}}|\d{{4}}-\d\d-\d\d)"
NUMBER = r"([A-Z]{0,3}\s?\d{1,4}[./-]\d{1,6}(?:[./-]\d{1,4})?|\d{4}\.[A-Z]{2,5}\.\d{1,5})"
NAME = r"(\p{Lu}[\p{L}.'-]+(?:\s(?:von|de|di|da|van)?\s?\p{Lu}[\p{L}'-]+){1,3})"
ONE_NAME = r"(\p{Lu}[\p{L}'-]+)"
VOM = r"(?:vom|du|del|le|il)"
AFFAIR_LABEL = r"(?:gesch[äa]fts?(?:-?\s?nr\.?|nummer)?|vorlage(?:n?-?nr\.?)?|n[°o]\s?(?:de l.)?objet|affaire|oggetto|traktandum)"
PLACE_DAY = rf"^\s*\p{{Lu}}[\p{{L}}. -]{{2,25}},\s*(?:den |le |il )?{DAY}\s*\.?\s*$"
ONLY_DAY = rf"^\s*{DAY}\s*$"
SIGN = r"im namen des|au nom du|per il"
_LABEL = r"(?:titel|titre|titolo|bezeichnung)"
_CUE = r"(?:betreffend|betr\.|concernant|intitul[ée]e?|riguardante)"
_SUBMIT = r"(?:eingereicht(?: am)?|eingang|eingegangen|d[ée]pos[ée]e?(?: le)?|date du d[ée]p[ôo]t|presentat[oa](?: il)?)"
_BY = r"(?:eingereicht von|erstunterzeichner(?:/?-?in)?|urheber(?:/?-?in)?|d[ée]pos[ée]e? par|auteur(?:e)?|presentat[oa] da|primo firmatario)"
i = "(?iu)"

# Words without one of which a part of a pattern matches nothing, in small letters.
register_mark("type", ("motion", "postulat", "interpella", "anfrage", "auftrag", "question", "iniziativa", "initiative", "mozione", "interrogazione"), TYPE)
register_mark("answer", ("antwort", "stellungnahme", "ponse", "risposta", "presa di"), ANSWER)
register_mark("body", ("regierungsrat", "gemeinderat", "stadtrat", "bundesrat", "staatsrat", "conseil ", "consiglio ", "municipio"), BODY)
register_mark("affair", ("gesch", "vorlage", "objet", "affaire", "oggetto", "traktandum"), AFFAIR_LABEL)
register_mark("label", ("titel", "titre", "titolo", "bezeichnung"), _LABEL)
register_mark("cue", ("betr", "concernant", "intitul", "riguardante"), _CUE)
register_mark("submit", ("eing", "dépos", "depos", "date du d", "presentat"), _SUBMIT)
register_mark("by", ("eingereicht von", "erstunterzeichner", "urheber", "dépos", "depos", "auteur", "presentat", "primo firmatario"), _BY)
register_mark("sign", ("im namen des", "au nom du", "per il"), SIGN)
register_mark("speaker", ("sprecher", "porte-parole"))
register_mark("handed", ("reichte",))
register_mark("request", ("antrag an den",))
register_mark("titled", ("titel", "intitul", "titolo"))
register_mark("digit", tuple("0123456789"))

register_tiers("affair_type", [
    Tier("type_cue_label", rf"{i}^\s*(?:vorstossart|art des vorstosses|type d.intervention|cat[ée]gorie|tipo di atto)\s*:?\s*({TYPE})\b"),
    Tier("type_checkbox", rf"{i}^\s*(?:\[?x\]?|☒|☑)\s*({TYPE})\b"),
    Tier("type_checkbox_odd_mark", rf"{i}^\s*[■●◉]\s*({TYPE})\s*$"),
    Tier("type_line_start", rf"{i}^\s*(?:\d{{1,3}}[.)]\s*)?(?:eingereichte |testo dell.)?({TYPE})\b", "head"),
    Tier("type_response_phrase", rf"{i}{ANSWER}[^.]{{0,60}}?\b({TYPE})\b", "head"),
    Tier("type_line_start_late", rf"{i}^\s*({TYPE})\b.{{0,80}}$", "late_head"),
    Tier("type_response_phrase_late", rf"{i}^\s*{ANSWER}[^.]{{0,60}}?\b({TYPE})\b", "late_head"),
    Tier("type_line_word", rf"{i}^\s*(anfrage|auftrag|question)\b", "page1", needs=("type",)),
    Tier("type_head_inline", rf"{i}^[^.]{{0,60}}?(?::|nr\.?\s\S+)\s*({TYPE})\b", "head"),
    Tier("type_line_start_gov", rf"{i}^\s*({TYPE})\b", "head", above=rf"{i}bericht|botschaft|messaggio|rapport"),
    Tier("type_head_inline_gov", rf"{i}(?:bericht|botschaft|messaggio|rapport)[^.]{{0,80}}?({TYPE})\b", "head"),
    Tier("type_submission_phrase", rf"{i}(?:folgende[nrs]?|a d[ée]pos[ée] (?:une?|la)|presenta la)\s+({TYPE})\b", "page1"),
    Tier("type_head_inline_text", rf"{i}\b({TYPE})\b", "head"),
    Tier("type_government_head", rf"{i}^\s*(botschaft|bericht und antrag|messaggio|beschlussantrag|d[ée]cret)\b(?!\s+du\s+\d)", "head"),
    Tier("type_government_phrase", rf"{i}\b(antrag an den)\s+(?:grossen rat|landrat|kantonsrat|gemeinderat)", "head", needs=("request",)),
])

register_tiers("affair_number", [
    Tier("number_cue_affair_line", rf"{i}^\s*{AFFAIR_LABEL}\s*:?\s*(?:nr\.?\s*)?{NUMBER}", "page1"),
    Tier("number_cue_affair_below", rf"^\s*{NUMBER}\s*$", "page1", above=rf"{i}^\s*{AFFAIR_LABEL}\s*:?\s*$"),
    Tier("number_cue_affair_table", rf"^\s*{NUMBER}(?:\t|\s{{2,}})", "page1", above=rf"{i}^\s*{AFFAIR_LABEL}(?:\t|\s{{2,}})"),
    Tier("number_cue_council", rf"{COUNCIL}[ -]Nr\.?\s*{NUMBER}", "page1"),
    Tier("number_cue_affair_council", rf"{COUNCIL}\s(?i:gesch[äa]ft)\s(?i:nr\.?)\s*{NUMBER}"),
    Tier("number_form_year_letters", r"(?<!Signatur )\b(\d{4}\.[A-Z]{2,5}\.\d{1,5})\b", "page1"),
    Tier("number_docpart_cue", r"(?:Reg\. )?Nr\.?:?\s*(\d{2}(?:-\d{2})?\.\d{3,4}\.\d{2})"),
    Tier("number_docpart_head", r"(?:^\s*|\s)(\d{2}\.\d{4}\.\d{2})\s*$", "head"),
    Tier("number_cue_affair_digits", rf"{i}^\s*{AFFAIR_LABEL}\s*:?\s*(?:nr\.?\s*)?(\d{{3,}})\s*$", "page1"),
    Tier("number_cue_intervention_line", rf"{i}vorstoss-?\s?(?:nr\.?|nummer)\s*:?\s*{NUMBER}"),
    Tier("number_cue_intervention_below", rf"^\s*{NUMBER}\s*$", above=rf"{i}^\s*vorstoss-?\s?(?:nr\.?|nummer)\s*:?\s*$"),
    Tier("number_nr_type", rf"{i}^\s*nr\.\s*(\S*\d\S*)\s+{TYPE}\b", "page1"),
    Tier("number_type_cue", rf"{i}^\s*{TYPE}\s+(?:nr\.?|no|n[°o]|nummer)\s*{NUMBER}", "head"),
    Tier("number_type_adjacent", rf"{i}^\s*{TYPE}\s+{NUMBER}", "head"),
    Tier("number_type_paren", rf"{i}\b{TYPE}\b[^()]{{0,60}}\({NUMBER}\)", "head"),
    Tier("number_bare_nr", rf"^\s*Nr\.?\s*{NUMBER}\s*$", "head"),
    Tier("number_line_dotted", r"^\s*(\d{2}\.\d{3,4})\b", "head"),
    Tier("number_line_dotted3", r"^\s*(\d{2}\.(?:1[3-9]|[2-9]\d)\.\d{2})\s*$", "head"),
    Tier("number_line_form", r"^\s*((?:M|P|I|A|MM N\.|MM)\s?\d{1,4}(?:/\d{2,4})?)\s*$", "head"),
    Tier("number_line_year_running", r"^\s*((?:19|20)\d{2}[./]\d{1,4}|\d{1,4}/(?:19|20)\d{2})\s*$", "head"),
    Tier("number_after_head_date", rf"{i}^\s*\d{{1,2}}\.?\s{MONTH}\s\d{{4}}\s*/\s*(\d+\.\d+)\s*$", "head"),
    Tier("number_line_dotted3_type", r"^\s*(\d{2}\.\d{2}\.\d{2})\s*$", "head", below=rf"{i}\b{TYPE}\b"),
    Tier("number_docpart_last_line", r"^\s*(\d{2}\.\d{4}\.\d{2})\s*$", "last3"),
    Tier("number_docpart_page1", r"^.{0,40}?\b(\d{2}\.\d{4}\.\d{2})\b.{0,40}$", "page1"),
    Tier("number_letter_code_cue", r"Pr[äa]sidial-Nr\.?\s*([A-Z]\d{6})"),
    Tier("number_letter_code_line", r"(?:^|\s)([A-Z]\d{6})\s*$", "page1"),
    Tier("number_type_cue_late", rf"{i}^\s*{TYPE}\s+(?:nr\.?|no|n[°o]|nummer)\s*{NUMBER}", "late_head"),
    Tier("number_type_adjacent_late", rf"{i}^\s*{TYPE}\s+{NUMBER}", "late_head"),
    Tier("number_paren_code", r"\(([A-Z]{1,2}\s?\d{3,5})\)"),
    Tier("number_cue_file", rf"{i}zu den akten\s*{NUMBER}"),
    Tier("number_bare_nr_late", rf"^\s*Nr\.?\s*{NUMBER}\s*$", "page1"),
    Tier("number_line_form_late", r"^\s*([MPIA]\s\d{1,4}/\d{4})\s*$", "page1"),
    Tier("number_form_year_letters_p2", r"\b(\d{4}\.[A-Z]{2,5}\.\d{1,5})\b"),
    Tier("number_type_cue_inline", rf"{i}\b{TYPE}\s+(?:nr\.?|no|n[°o]|nummer)\s*{NUMBER}"),
    Tier("number_type_adjacent_inline", rf"{i}\b{TYPE}\s+{NUMBER}"),
    Tier("number_type_adjacent_digits", rf"{i}\b{TYPE}\s+(\d{{3,5}})(?=;|\s+betr)"),
    Tier("number_cue_running_footer", r"Laufnummer\s*:?\s*(\d+)"),
    Tier("number_cue_affair_sentence", rf"{i}gesch[äa]fts-?nr\.?\s*{NUMBER}\s+\p{{Ll}}"),
    Tier("number_type_cue_seq", rf"{i}\b{TYPE}\s+nr\.?\s*(\d{{1,3}})\b"),
    Tier("number_cue_affair_short", rf"{i}gesch[äa]ft\s+nr\.?\s*(\d{{1,2}}|\d\.\d)\b"),
    Tier("number_form_year_serial6", r"\b(\d{2}\.\d{6})\b", "head"),
    Tier("number_cue_bare_label", r"^\s*(\d{2,6})\s*$", "head", above=rf"{i}^\s*(?:numero|nummer)\s*:?\s*$"),
    Tier("number_line_registry_code", r"\s([A-Z]?\s?\d\.\d\.\d)\s*$", "head"),
], needs=("digit",))

register_tiers("title", [
    Tier("label_cue", rf"{i}^\s*{_LABEL}\s*:\s*(\S.{{2,}})$"),
    Tier("label_no_colon", rf"{i}^\s*{_LABEL}\s+(\p{{Lu}}.{{4,}})$", "page1"),
    Tier("label_stack_last", r"^\s*(\S.{4,})$", "page1", above=rf"{i}^\s*{_LABEL}\s*:?\s*$"),
    Tier("label_affair_cell", r"(?iu)^\s*(?:gesch[äa]ft|vorlage|vorstoss|traktandum)(?:\t|\s{2,})(\S.{4,})$"),
    Tier("cue_line", rf"{i}^\s*{_CUE}\s+(\S.{{3,}})$", "page1"),
    Tier("cue_in_line", rf"{i}^.{{0,80}}\b(?:betreffend|betr\.)\s+(\S.{{3,}})$", "head", needs=("cue",)),
    Tier("number_line_title", r"^\s*\d{2}\.\d{3,4}\s+(\p{L}.{4,})$", "head25", needs=("digit",)),
    Tier("type_semicolon", rf"{i}^\s*{TYPE}[^;]*;\s*([^;]{{5,}})(?:;|$)", "head"),
    Tier("type_list_item", rf"{i}^\s*[-•–]\s*{TYPE}\s+(\S.{{4,}})$", "head"),
    Tier("type_quoted", rf"{i}^\s*{TYPE}\b[^«»\"„“”]{{0,80}}[«\"„“]([^«»\"„“”]{{3,}})[»\"“”]", "page1"),
    Tier("type_cue", rf"{i}^\s*{TYPE}\b.{{0,80}}?\b(?:betreffend|betr\.|bez[üu]glich|zur|zum|concernant|relative? [àa]|in merito a)\s+(\S.{{3,}})$", "page1"),
    Tier("type_colon", rf"{i}^\s*{TYPE}\b[^:–-]{{0,60}}(?::|\s[–-]\s)\s*(\S.{{3,}})$", "page1"),
    Tier("type_plain", rf"{i}^\s*{TYPE}\s+(?:nr\.?\s*\S+\s+)?(\p{{L}}\S*(?:\s+\S+){{3,}})$", "page1"),
    Tier("type_plain_short", rf"{i}^\s*{TYPE}\s+(\p{{L}}\S*(?:\s+\S+){{0,2}})\s*$", "head"),
    Tier("before_type_line", r"^\s*(\p{L}.{8,})$", "head", below=rf"{i}^\s*{TYPE}\s+\p{{L}}"),
    Tier("after_type_heading", r"^\s*(\p{Lu}.{4,})$", "page1", above=rf"{i}^\s*{TYPE}\s*$"),
    Tier("after_kind_heading", r"^\s*(\p{Lu}.{4,})$", "page1", above=r"(?iu)^\s*(?:bericht und antrag|botschaft|messaggio)\b[^.]{0,60}$"),
    Tier("sentence_titled_quote", r"(?iu)(?:mit dem titel|intitul[ée]e?|dal titolo)\s+[«\"„“]([^«»\"„“”]{3,})", "page1", needs=("titled",)),
    Tier("sentence_type_quote", rf"{i}\b{TYPE}\b[^«»\"„“”]{{0,80}}[«\"„“]([^«»\"„“”]{{3,}})[»\"“”]", "page1"),
], line_first=True)

register_tiers("submission_date", [
    Tier("sub_label_cue", rf"{i}^\s*{_SUBMIT}\s*(?:am|le|il)?\s*:?\s*{DAY}", roles="not_response"),
    Tier("sub_label_table", ONLY_DAY, above=rf"{i}^\s*{_SUBMIT}\s*:?\s*$"),
    Tier("sub_label_cue_resp", rf"{i}^\s*{_SUBMIT}\s*(?:am|le|il)?\s*:?\s*{DAY}", roles="response"),
    Tier("sub_type_date_near", rf"{i}^\s*{TYPE}\b[^.]{{0,40}}\b{VOM}\s+{DAY}", roles="not_response"),
    Tier("sub_resp_head_near", rf"{i}^\s*(?:{ANSWER}\b[^.]{{0,40}})?{TYPE}\b[^.]{{0,40}}\b{VOM}\s+{DAY}", "head", roles="response", loose=("answer",)),
    Tier("sub_signers_date", PLACE_DAY, below=r"(?iu)^\s*(?:die unterzeichnenden|erstunterzeichn|les soussign|firmatari)"),
    Tier("sub_resp_head_far", rf"{i}^\s*{TYPE}\b.{{0,250}}\b{VOM}\s+{DAY}", "head", roles="response"),
    Tier("sub_sentence_cue", rf"{i}\bam\s+{DAY}\s.{{0,120}}\b(?:reichte|reichten|eingereicht)", "head25", roles="not_proposal"),
    Tier("sub_type_date_far", rf"{i}^\s*{TYPE}\b.{{0,250}}\b{VOM}\s+{DAY}"),
    Tier("sub_type_date_inline", rf"{i}\b{TYPE}\s+(?:\p{{L}}+\s+){{0,4}}{VOM}\s+{DAY}", roles="not_proposal"),
    Tier("sub_sentence_meeting", rf"{i}(?:an der sitzung|en s[ée]ance|nella seduta)\s+(?:vom|du|del)\s+{DAY}.{{0,120}}(?:reicht|eingereicht|d[ée]pos|presentat)", roles="not_proposal"),
    Tier("sub_letter_head", PLACE_DAY, "head25", roles="proposal"),
    Tier("sub_letter_tail", PLACE_DAY, "tail", roles="proposal"),
    Tier("sub_head_date_line", ONLY_DAY, "head", roles="proposal"),
    Tier("sub_tail_date_line", ONLY_DAY, "tail", roles="proposal"),
    Tier("sub_letter_body", PLACE_DAY, roles="proposal"),
    Tier("sub_sentence_other", rf"{i}\bam\s+{DAY}\s.{{0,120}}\b(?:reichte|eingereicht)", roles="proposal"),
    Tier("sub_dispatch_date", rf"{i}^\s*(?:bericht und antrag|weisung|messaggio n\.\s*\d+)\b[^.]{{0,40}}\b(?:vom|del)\s+{DAY}"),
    Tier("sub_dispatch_letter", PLACE_DAY, "first6", roles="other"),
], needs=("digit",))

register_tiers("response_date", [
    Tier("resp_cue_date", rf"{i}^\s*{ANSWER}\s+(?:des|du|del|der)\s+{BODY}\w*[^.]{{0,40}}\b{VOM}\s+{DAY}", "head"),
    Tier("resp_approval_date", rf"{i}(?:approuv[ée]e?|adopt[ée]e?) par le conseil municipal (?:le|en s[ée]ance du)\s+{DAY}"),
    Tier("resp_decision_date", rf"{i}^\s*(?:(?:regierungsrats|gemeinderats|stadtrats)beschluss|RRB|SRB|GRB)\b[^.]{{0,30}}\b{VOM}\s+{DAY}"),
    Tier("resp_minute_head", rf"{i}^\s*(?:auszug aus dem protokoll|sitzung|estratto|extrait)\b[^.]{{0,60}}\b{VOM}\s+{DAY}", "head"),
    Tier("resp_heading_date", rf"{i}^\s*{VOM}\s+{DAY}\s*$", "head", above=rf"{i}{ANSWER}"),
    Tier("resp_signature_date", PLACE_DAY, below=rf"{i}{SIGN}"),
    Tier("resp_letter_head", PLACE_DAY, "head", roles="response"),
    Tier("resp_letter_tail", PLACE_DAY, "tail", roles="response"),
    Tier("resp_cue_text", rf"{i}\b{ANSWER}\s+(?:des|du|del|der)\s+{BODY}\w*[^.]{{0,40}}\b{VOM}\s+{DAY}"),
    Tier("resp_page1_date_line", ONLY_DAY, "page1", roles="response"),
    Tier("resp_tail_date_line", ONLY_DAY, "tail", roles="response"),
    Tier("resp_cited_date", rf"{i}stellungnahme\b[^.]{{0,60}}\b{VOM}\s+{DAY}", roles="not_response"),
], needs=("digit",))

register_tiers("responder", [
    Tier("rsp_response_cue", rf"{i}{ANSWER}\s+(?:des|du|del|der)\s+({BODY})|der\s+({BODY})\s+antwortet", roles="not_proposal", loose=("answer",)),
    Tier("rsp_signature", rf"{i}(?:{SIGN})\s+({BODY})"),
    Tier("rsp_signature_place", rf"{i}^\s*(?:der |le |il )?({BODY})\w*\s*$", above=PLACE_DAY),
    Tier("rsp_minute_cue", rf"{i}^\s*(?:auszug aus dem protokoll|estratto dal protocollo|extrait du proc[èe]s-verbal)\s+(?:des|du|del)\s+({BODY})", "page1"),
    Tier("rsp_decision_body", r"(?iu)^\s*(regierungsrat|gemeinderat|stadtrat)s?beschluss", "first6", needs=("body",)),
    Tier("rsp_letter_head", rf"{i}^\s*(?:der |le |il )?({BODY})\w*(?:\s\p{{Lu}}\p{{L}}+)?\s*$", "head", roles="response"),
    Tier("rsp_tail_line", rf"{i}^\s*(?:der |le |il )?({BODY})\w*(?:\s\p{{Lu}}\p{{L}}+)?\s*$", "tail", roles="response"),
    Tier("rsp_sender_block", rf"{i}^\s*({BODY})\w*\s*$", "page1", below=r"(?iu)strasse|platz|rue|via|tel\.|@", roles="response"),
    Tier("rsp_page_line", rf"{i}^\s*(?:stadt|gemeinde|kanton|ville|canton|comune)\s\p{{L}}+\s+({BODY})\w*", roles="response"),
    Tier("rsp_response_block", rf"{i}\b(?:der|le|il)\s+({BODY})\b", roles="response"),
    Tier("rsp_addressee_cue", rf"{i}(?:der\s+({BODY})\s+wird\s+(?:gebeten|beauftragt|eingeladen))|(?:ich bitte den|wir bitten den|lodevole)\s+({BODY})"),
    Tier("rsp_response_text", rf"{i}{ANSWER}\s+(?:des|du|del|der)\s+({BODY})"),
])

register_tiers("first_author", [
    Tier("label_same_line", rf"(?iu:^\s*{_BY}\s*:?\s*){NAME}"),
    Tier("type_prep_name", rf"(?iu:^\s*{TYPE}\s+(?:von|de|di|der)\s+){NAME}", "head25"),
    Tier("response_head_prep_name", rf"(?iu:^\s*{ANSWER}\b.{{0,60}}\b{TYPE}\s+(?:von|de|di)\s+){NAME}", "head25"),
    Tier("type_group_bracket", rf"(?iu:^\s*{TYPE}\b)[^()]{{0,60}}\({NAME}", "head25"),
    Tier("type_separator_name", rf"(?iu:^\s*{TYPE}\b)[^;]{{0,30}};\s*{NAME}\s*(?:;|$)", "head"),
    Tier("spokesperson_entry", rf"{ONE_NAME}\s\([^()]{{2,40}}\)\s*\((?:Sprecher|porte-parole)", needs=("speaker",)),
    Tier("addressee_member", rf"^\s*{NAME}\s*$", "head25", above=r"(?iu)^\s*(?:herr(?:n)?|frau|madame|monsieur|signora?)\s*$"),
    Tier("label_next_lines", rf"^\s*{NAME}", above=rf"(?iu)^\s*{_BY}\s*:?\s*$"),
    Tier("label_form_fields", rf"^\s*{ONE_NAME}\s*$", above=r"(?iu)^\s*(?:name|nom|cognome)\s*:?\s*$"),
    Tier("sender_signature", rf"^\s*{NAME}\s*$", "first6", roles="proposal"),
    Tier("type_entry_name", rf"(?iu:^\s*{TYPE}\s+){ONE_NAME}\s\([^()]{{2,40}}\)", "head25"),
    Tier("type_full_name", rf"(?iu:^\s*{TYPE}\s+){NAME}", "head25"),
    Tier("response_head_full_name", rf"(?iu:^\s*(?:bericht|{ANSWER})\b.{{0,60}}\b{TYPE}\s+){NAME}", "head25", loose=("answer",)),
    Tier("addressee_reply", rf"^\s*(?:Herr(?:n)?|Frau|Madame|Monsieur|Signora?)\s+{NAME}\s*$", "head25"),
    Tier("narrative_submit", rf"(?iu:reichte\s+(?:\p{{L}}+r[äa]t(?:in)?\s+)?){NAME}", "page1", needs=("handed",)),
    Tier("head_sender_marked", rf"^\s*{NAME},?\s*(?:\(?(?:SP|SVP|FDP|CVP|GLP|Die Mitte|Grüne|PLR|PS|UDC|PPD)\)?)\s*$", "head"),
    Tier("signature_marked", rf"^\s*{NAME},?\s*(?:\(?(?:SP|SVP|FDP|CVP|GLP|Die Mitte|Grüne|PLR|PS|UDC|PPD)\)?)\s*$", "tail"),
    Tier("type_prep_cosigners", rf"(?iu:\b{TYPE}\s+(?:von|de|di)\s+){NAME}(?=\s+(?:und|et|e)\s+(?:Mitunterz|consorts|cofirm))", "page1"),
    Tier("type_family_name", rf"(?iu:^\s*{TYPE}\s+){ONE_NAME}\s*:", "head"),
    Tier("signature_plain", rf"^\s*{NAME}\s*$", "tail", roles="proposal"),
    Tier("type_in_sentence", rf"(?iu:\b(?:das|die|le|la|il)\s+{TYPE}\s+(?:von|de|di)\s+){NAME}"),
    Tier("signature_untyped", rf"^\s*{NAME}\s*$", "last3"),
])

# What stands before or behind numbers that are no numbers of affairs, and causes.
_LAW_BEFORE = r"(?iu)(?:\b(?:SR|RS|LS|BGS|RSF|Art\.?|Ziff\.?|Abs\.?)|§)\s*$"
_AMOUNT_BEFORE, _AMOUNT_AFTER = r"(?iu)(?:CHF|Fr\.|Franken|€)\s*$", r"(?iu)^\s*(?:CHF|Franken|Fr\.|%|Mio|Mrd)"
_PAGE_BEFORE = r"(?iu)(?:\bS\.|Seite|page|pagina)\s*$"
_CUE_BEFORE = rf"(?iu)(?:{AFFAIR_LABEL}|vorstoss-?\s?(?:nr\.?|nummer))\s*:?\s*(?:nr\.?\s*)?$"
_DECISION_BEFORE = r"(?iu)(?:beschluss|d[ée]cision|decisione|RRB|SRB|GRB)\b[^0-9]*$"


def number_refusal(line: Column, value: Column, at: Column) -> Column:
    """Why a number isn't that of an affair: date, phone, law_number, amount, page_number, postal_code, year, decision_number; null if it may be.

    Right behind a word that announces a number, short dates, page numbers, postal codes and years count as numbers.
    """
    before, after = F.substring(line, F.lit(1), at), F.substr(line, at + F.length(value) + 1)
    solid = F.trim(value)
    told = before.rlike(_CUE_BEFORE)
    is_date = F.exists(find_dates(line), lambda h: (h["start"] < at + F.length(value)) & (h["stop"] > at) & (~told | F.substr(line, h["start"] + 1, h["stop"] - h["start"]).rlike(r"\d{4}")))
    return (
        F.when(is_date, "date").when(solid.rlike(r"^(?:0\d{2} ?\d{3} ?\d{2} ?\d{2}|\d{3} \d{2} \d{2})$"), "phone").when(before.rlike(_LAW_BEFORE), "law_number")
        .when(before.rlike(_AMOUNT_BEFORE) | after.rlike(_AMOUNT_AFTER), "amount").when(before.rlike(_PAGE_BEFORE) | (solid.rlike(r"^\d{1,3}\s?/\s?\d{1,3}$") & ~told), "page_number")
        .when(~told & solid.rlike(r"^\d{4}$") & after.rlike(r"^\s+\p{Lu}\p{Ll}{2,}"), "postal_code").when(~told & solid.rlike(r"^(?:19|20)\d{2}(?:\s?[-/]\s?(?:19|20)\d{2})?$"), "year").when(F.right(before, F.lit(40)).rlike(_DECISION_BEFORE), "decision_number")
    )


register_refusals("affair_number", number_refusal)
