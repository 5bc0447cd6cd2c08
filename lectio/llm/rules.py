"""Line-first cleaning: rules judge each line, lines that fail are removed, and documents that lose too much text are rejected.

All of it is one column expression over the lines of a text, evaluated where the text is read: no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A document is rejected if less than this part of its text (characters of lines that aren't blank) is left.
LEAST_KEPT = 0.5
#: Separators that make a line one of navigation, unless it begins and ends with one, as the rows of a table do.
SEPARATORS = 3
#: Words of menus, in the four languages of the corpus; a line of nothing else is one of navigation, however long.
NAVIGATION = (
    "home|next|previous|prev|back|menu|login|log in|logout|sign in|sign up|register|search|contact|contact us|about|about us|sitemap|faq|help|top|share|print|rss"
    "|startseite|zurück|weiter|anmelden|abmelden|registrieren|suche|kontakt|über uns|hilfe|nach oben|drucken|impressum|datenschutz"
    "|accueil|suivant|précédent|retour|connexion|déconnexion|inscription|recherche|à propos|plan du site|aide|imprimer"
    "|inicio|siguiente|anterior|volver|menú|iniciar sesión|cerrar sesión|registrarse|buscar|contacto|acerca de|mapa del sitio|ayuda|imprimir"
)
#: Phrases of boilerplate, which fail a line of any length wherever they begin a word; and those that do so where it begins with them. In lower case.
BOILERPLATE = (
    "all rights reserved|cookie policy|privacy policy|terms of use|terms of service|this work is licensed|this file is licensed|this software is licensed|click here|read more|subscribe to our|enable javascript|powered by"
    "|alle rechte vorbehalten|datenschutzerklärung|cookie-richtlinie|nutzungsbedingungen|lizenziert unter|newsletter abonnieren|javascript aktivieren"
    "|tous droits réservés|mentions légales|politique de confidentialité|politique de cookies|conditions d'utilisation|sous licence|abonnez-vous à notre|cliquez ici|lire la suite"
    "|todos los derechos reservados|aviso legal|política de privacidad|política de cookies|términos de uso|bajo licencia|haga clic aquí|leer más|suscríbase a"
)
BEGINNINGS = "licensed under|released under|copyright|impressum"
#: Runs of signs such as "%%%" or "!!", which running text hasn't; a line with so many for each of its words fails.
NOISE, NOISE_SHARE = "[!?#$%&*^~=+_<>@]{2,}", 0.25
#: A line of so many words without a mark that ends or parts a sentence fails, unless it is the row of a table.
LONG_LINE = 12
#: A line of so many words of which this part is the same as the word before fails.
REPEATS, REPEAT_SHARE = 6, 0.3


def _tree(phrases: list[str]) -> str:
    """A pattern of any of these phrases, in which common beginnings are looked at once."""
    if "" in phrases:
        return ""
    heads: dict[str, list[str]] = {}
    for p in phrases:
        heads.setdefault(p[0], []).append(p[1:])
    parts = [head + _tree(rest) for head, rest in heads.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _line(duck: bool) -> str:
    """SQL that is true if line l (trimmed, not empty) stays."""
    hit = (lambda c, p: f"regexp_matches({c}, '{p}')") if duck else (lambda c, p: f"{c} RLIKE '{p}'")
    count = (lambda p: f"len(regexp_extract_all(l, '{p}'))") if duck else (lambda p: f"regexp_count(l, '{p}')")
    words = "(length(l) - length(replace(l, ' ', '')) + 1)"
    row, low = "l LIKE '|%|'", "lower(l)"
    # In Java possessive, so that a menu of any length takes neither stack nor backtracking; for that, longer words stand first.
    menu, keep = "|".join(sorted(NAVIGATION.split("|"), key=len, reverse=True)), "" if duck else "+"
    navigation = f"(length(l) - length(replace(l, '|', '')) >= {SEPARATORS} AND NOT {row}) OR {hit(low, f'^[ >|/]*{keep}(?:(?:{menu})[ >|/]*{keep})+{keep}$')}"
    phrases = [p.replace("'", "''") for p in BOILERPLATE.split("|")]
    word = r"(?:^|[^\p{L}\p{N}])" if duck else r"(?<![\\p{L}\\p{N}])"
    boilerplate = f"{hit(low, word + _tree(phrases))} OR {hit(low, f'^(?:{BEGINNINGS})')}"
    if duck:
        same = "len(list_filter(list_zip(string_split(l, ' '), string_split(l, ' ')[2:]), lambda p: p[1] = p[2] AND p[1] <> ''))"
    else:
        same = r"regexp_count(concat(' ', l), ' ([^ ]++)(?= \\1(?: |$))')"
    punctuation = f"{count(NOISE)} >= {NOISE_SHARE}e0 * {words} OR ({words} >= {LONG_LINE} AND NOT {hit('l', '[.!?:;,。！？]')} AND NOT {row})"
    repeats = f"({words} >= {REPEATS} AND {same} >= {REPEAT_SHARE}e0 * {words})"
    return f"NOT ({navigation} OR {boilerplate} OR {punctuation} OR {repeats})"


def _trimmed(duck: bool) -> str:
    blank = "chr(32) || chr(9) || chr(13)" if duck else r"concat(' ', char(9), char(13))"
    return f"trim(l, {blank})" if duck else f"btrim(l, {blank})"


def clean(docs: DataFrame, least_kept: float = LEAST_KEPT) -> DataFrame:
    """The documents that pass, with the lines that failed taken out of text, and n_chars set anew where there is one.

    A line fails by navigation (separators, or nothing but words of menus), boilerplate (phrases of licences, cookies and
    such), punctuation (runs of signs, or many words without a mark) or repetition (words that are the same as the one
    before), whatever its length. Blank lines stay, and so do the rows of tables. A document is rejected if under least_kept
    of its characters, blank lines and margins aside, are in lines that stay; so are null, empty and blank texts, which have
    nothing to keep. All other columns, also null ids and repeated rows, stay as they are. An empty table gives no rows.
    """
    trimmed = _trimmed(False)
    stays = f"exists(array({trimmed.replace('(l,', '(x,')}), l -> l = '' OR ({_line(False)}))"
    size = lambda a: f"aggregate({a}, 0L, (n, l) -> n + length({trimmed}))"
    # One generator holds the whole of it: as a projection and a filter, the optimizer would judge every line in both.
    judged = f"transform(transform(array(split(string(text), '\n', -1)), a -> named_struct('a', a, 'kept', filter(a, x -> {stays}))), s -> named_struct('new', array_join(s.kept, '\n'), 'size', {size('s.kept')}, 'whole', {size('s.a')}))"
    names = docs.columns
    work = docs.where("text IS NOT NULL").select(F.struct(*names).alias("row"), F.expr(f"inline(filter({judged}, s -> s.size > 0 AND s.size >= {least_kept}e0 * s.whole))"))
    new = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return work.select(*(new[c.lower()].alias(c) if c.lower() in new else F.col("row")[c].alias(c) for c in names))


ORACLE = f"""
WITH a AS (SELECT *, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
     b AS (SELECT *, list_filter(lines, lambda x: len(list_filter([{_trimmed(True).replace("(l,", "(x,")}], lambda l: l = '' OR ({_line(True)}))) > 0) AS kept FROM a),
     c AS (SELECT *, list_sum(list_transform(kept, lambda l: length({_trimmed(True)}))) AS size, list_sum(list_transform(lines, lambda l: length({_trimmed(True)}))) AS whole FROM b)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, lang, source, CAST(length(array_to_string(kept, chr(10))) AS BIGINT) AS n_chars
FROM c WHERE size > 0 AND size >= {LEAST_KEPT}e0 * whole
"""
