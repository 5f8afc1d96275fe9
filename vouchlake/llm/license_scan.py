"""Licence scans by sentence-rule recognition, DataFrame functions only.

Texts are normalised: lower case, other characters to one space, S for a line
break, H for the end of a sentence. Sentences of the catalogue are looked up
where one begins and ends at S or H; S may stand between any two of its words
(wrapped lines), two S in a row (an empty line) may not. A subject before the
sentence ("this file is") is passed over. Notices are a verb and licence names, one or a
list (joined by and, or, with, or commas), or an SPDX expression; exceptions are passed over.
The sequence of identifiers of a document is matched against ordered rules, and
a licence gives way to a narrower one found (BROADER). Null or empty text has
no findings.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GNU = "free software|you can redistribute it and or modify it under the terms of"
_FSF = "as published by the free software foundation"
_LATER = "or at your option any later version"
_OR_LATER = "of the license or at your option any later version"
_BSD_AS_IS = "this software is provided by the {} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_BSD_OWNERS = ("copyright holders and contributors", "copyright holder and contributors", "author and contributors", "authors and contributors", "regents and contributors", "author", "authors", "copyright holder", "copyright holders")
#: Normalised names, as they stand after a verb, by identifier.
NAMES = {
    "apache-2.0-notice": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license v2 0", "apache 2 0", "apache version 2 0 license"),
    "mit-notice": ("mit license", "mit", "mit expat license", "expat license", "mit open source license", "x11 mit license"),
    "cc-by-nc-4.0-notice": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0 international", "creative commons attribution non commercial 4 0 international license"),
    "cc-by-nc-sa-4.0-notice": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"),
    "cc-by-4.0-notice": ("cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 international", "creative commons attribution 4 0 license"),
    "cc-by-sa-4.0-notice": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 international", "creative commons attribution share alike 4 0 international license"),
    "cc-by-sa-3.0-notice": ("cc by sa 3 0", "creative commons attribution sharealike 3 0 unported license", "creative commons attribution sharealike 3 0 license"),
    "cc0-1.0-notice": ("cc0 1 0", "cc0", "cc0 1 0 universal", "cc0 1 0 universal license", "creative commons zero v1 0 universal", "creative commons cc0 1 0 universal license"),
    "bsd-2-notice": ("bsd 2 clause", "bsd 2 clause license", "2 clause bsd license", "two clause bsd license", "simplified bsd license", "freebsd license"),
    "bsd-3-notice": ("bsd 3 clause", "bsd 3 clause license", "3 clause bsd license", "three clause bsd license", "new bsd license", "modified bsd license", "revised bsd license"),
    "bsd-notice": ("bsd license", "bsd style license", "bsd"),
    "isc-notice": ("isc license", "isc"),
    "mpl-2.0-notice": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mpl 2 0", "mpl v2 0"),
    "unlicense-notice": ("unlicense", "the unlicense"),
} | {
    f"{kind}-{version}{suffix}-notice": tuple(
        name
        for tail in tails
        for v in (number, number.removesuffix(" 0"))
        for name in (f"gnu {long} version {v}{tail}", f"gnu {long} v{v}{tail}", f"{long} version {v}{tail}", f"gnu {kind} version {v}{tail}", f"gnu {kind} v{v}{tail}", f"{kind} version {v}{tail}", f"{kind} v{v}{tail}", f"{kind} {v}{tail}", f"{kind}v{v}{tail}")
    )
    for kind, long, versions in (("gpl", "general public license", ("2.0", "3.0")), ("lgpl", "lesser general public license", ("2.1", "3.0")), ("agpl", "affero general public license", ("3.0",)))
    for version in versions
    for number in (version.replace(".", " "),)
    for suffix, tails in (("", ("", " only", " license")), ("-or-later", (" or later", " or any later version", " or at your option any later version", " or newer")))
}
#: Normalised sentence -> identifier; | may also be the end of a sentence.
SENTENCES = {
    "you may not use this file except in compliance with the license": "apache-2.0-compliance",
    "you may not use this work except in compliance with the license": "apache-2.0-compliance",
    "you may not use this software except in compliance with the license": "apache-2.0-compliance",
    "you may obtain a copy of the license at": "apache-2.0-copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2.0-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-2.0-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2.0-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache-2.0-language",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the names of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0-form",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0-form",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2.0-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2.0-copy",
    "free and unencumbered software released into the public domain": "unlicense-release",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-1.0-waiver",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-1.0-waiver",
    "to view a copy of this license visit http creativecommons org licenses by 4 0": "cc-by-4.0-copy",
    "to view a copy of this license visit http creativecommons org licenses by sa 4 0": "cc-by-sa-4.0-copy",
    "to view a copy of this license visit http creativecommons org licenses by nc 4 0": "cc-by-nc-4.0-copy",
    "free software": "gpl-free-software",
    "you should have received a copy of the gnu general public license along with this program": "gpl-received",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl-received",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl-received",
}
SENTENCES |= {_BSD_AS_IS.format(f"{the}{o}"): "bsd-as-is" for o in _BSD_OWNERS for the in ("", "the ")}
SENTENCES |= {
    f"{_GNU} the gnu {long} {_FSF}|{either}version {v.replace('.', ' ').removesuffix(' 0')} {tail}": f"{kind}-{v}{suffix}-notice"
    for kind, long, versions in (("gpl", "general public license", ("2.0", "3.0")), ("lgpl", "lesser general public license", ("2.1", "3.0")), ("lgpl", "library general public license", ("2.0",)), ("agpl", "affero general public license", ("3.0",)))
    for v in versions
    for either, tail, suffix in (("either ", _OR_LATER, "-or-later"), ("", _OR_LATER, "-or-later"), ("either ", _LATER, "-or-later"), ("", _LATER, "-or-later"), ("", "of the license", ""))
}
#: Fixed values: (ordered identifiers, licence); a rule needs its identifiers in this order.
RULES = [
    (("apache-2.0-notice",), "Apache-2.0"),
    (("apache-2.0-compliance", "apache-2.0-copy"), "Apache-2.0"),
    (("apache-2.0-copy", "apache-2.0-warranty"), "Apache-2.0"),
    (("apache-2.0-warranty", "apache-2.0-language"), "Apache-2.0"),
    (("mit-notice",), "MIT"),
    (("mit-grant",), "MIT"),
    (("mit-condition",), "MIT"),
    (("cc-by-nc-4.0-notice",), "CC-BY-NC-4.0"),
    (("cc-by-nc-4.0-copy",), "CC-BY-NC-4.0"),
    (("cc-by-nc-sa-4.0-notice",), "CC-BY-NC-SA-4.0"),
    (("cc-by-4.0-notice",), "CC-BY-4.0"),
    (("cc-by-4.0-copy",), "CC-BY-4.0"),
    (("cc-by-sa-4.0-notice",), "CC-BY-SA-4.0"),
    (("cc-by-sa-4.0-copy",), "CC-BY-SA-4.0"),
    (("cc-by-sa-3.0-notice",), "CC-BY-SA-3.0"),
    (("cc0-1.0-notice",), "CC0-1.0"),
    (("cc0-1.0-waiver",), "CC0-1.0"),
    (("bsd-2-notice",), "BSD-2-Clause"),
    (("bsd-3-notice",), "BSD-3-Clause"),
    (("bsd-notice",), "BSD"),
    (("bsd-grant",), "BSD"),
    (("bsd-as-is",), "BSD"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("isc-notice",), "ISC"),
    (("isc-grant",), "ISC"),
    (("0bsd-grant",), "0BSD"),
    (("mpl-2.0-notice",), "MPL-2.0"),
    (("mpl-2.0-form",), "MPL-2.0"),
    (("mpl-2.0-copy",), "MPL-2.0"),
    (("unlicense-notice",), "Unlicense"),
    (("unlicense-release",), "Unlicense"),
    (("unlicense-grant",), "Unlicense"),
    (("gpl-free-software", "gpl-received"), "GPL"),
    (("gpl-received",), "GPL"),
    (("lgpl-received",), "LGPL"),
    (("agpl-received",), "AGPL"),
]
_GNU_IDS = sorted({i for i in [*NAMES, *SENTENCES.values()] if re.match(r"(l|a)?gpl-\d", i)})
RULES += [((i,), i.removesuffix("-notice").replace("gpl", "GPL").replace("lGPL", "LGPL").replace("aGPL", "AGPL")) for i in _GNU_IDS]
#: A licence is left out where one that begins with any of these is found.
BROADER = {"BSD": ("BSD-",), "BSD-2-Clause": ("BSD-3-Clause",), "GPL": ("GPL-",), "LGPL": ("LGPL-",), "AGPL": ("AGPL-",)}
TRIGGER = "(?i)(licen[sc]e|permission|free\\s+software|unencumbered|redistribution|waived|dedicated|anyone is free|copy of the mpl|(?:released|distributed|available|provided|published|covered)\\s+under|provided\\s+by)"

_GAP, _ANY = "(?: S)? ", "(?: [HS]){0,2} "
_VERB = "(?:(?:made |also |hereby |dual )?(?:licensed|released|distributed|available|provided|published|covered) under (?:the terms (?:and conditions )?of )?(?:either (?:of )?)?(?:the |an? )?(?:version of the )?|spdx license identifier )"
_LEAD = "(?:(?!(?:[a-z0-9]+ (?:S )?){0,7}(?:that|if|whether|not|no|never) )(?:[a-z0-9]+ (?:S )?){1,8}?(?:is|are) )?"
#: Between the names of a list.
_AND = " (?:(?:and or|and|or|with) )?(?:at your option )?(?:the |an? )?"
_TAIL = "(?: with (?:the )?(?:[a-z0-9]+ ){1,4}exception(?: [0-9]+){0,2})?(?: the license| the licence)?(?: (?:see|as found in|which can be found|found in|a copy of which)(?: (?:S )?[a-z0-9]+){1,14}?)?"


def _first(texts: Iterable[str]) -> list[str]:
    """Longer ones before shorter ones."""
    return sorted(texts, key=lambda x: (-len(x), x))


def _names() -> str:
    """The next name of a list."""
    return "(?<= )(" + "|".join(_first(n for ns in NAMES.values() for n in ns)) + ")(?= |$)"


def _pattern() -> str:
    names = "|".join(_first(n for ns in NAMES.values() for n in ns))
    notice = f"{_VERB}(?:{names})(?:{_AND}(?:{names}))*".replace(" ", _GAP)
    whole = "|".join(s.replace(" ", _GAP).replace("|", _ANY) for s in _first(SENTENCES))
    return f"(?<=[HS] ){_LEAD.replace('are) ', 'are)' + _GAP)}((?:{notice})(?={_TAIL} [HS])|(?:{whole})(?= [HS]))"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licenses, n_sentences for every document."""
    keys = {f"> {n}": i for i, ns in NAMES.items() for n in ns} | {s.replace("|", " "): i for s, i in SENTENCES.items()}
    table = F.create_map(*[F.lit(x) for kv in keys.items() for x in kv])
    marked = F.regexp_replace(F.lower("text"), "(?<![a-z])v\\.\\s+(?=[0-9])", "v ")
    marked = F.regexp_replace(marked, "[.!?;]+[\"')\\]]*(?=\\s|$)", " H ")
    marked = F.regexp_replace(marked, "\\r\\n?|[\\n\\x85\\u2028\\u2029]", " S ")
    plain = F.concat(F.lit("H "), F.regexp_replace(F.regexp_replace(marked, "[^a-z0-9HS]+", " "), "^ | $", ""), F.lit(" H"))
    cores = F.regexp_extract_all(F.when(F.col("text").rlike(TRIGGER), plain).otherwise(F.lit("")), F.lit(_pattern()), 1)
    clean = F.transform(cores, lambda s: F.regexp_replace(F.regexp_replace(s, " [HS](?= )", ""), "^" + _VERB, "> "))
    listed = lambda s: F.transform(F.regexp_extract_all(s, F.lit(_names()), F.lit(1)), lambda n: F.element_at(table, F.concat(F.lit("> "), n)))
    found = F.flatten(F.transform(clean, lambda s: F.when(s.startswith("> "), listed(s)).otherwise(F.array(F.element_at(table, s)))))
    ids = F.filter(found, lambda i: i.isNotNull())
    seq = F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" "))
    hits = [F.when(seq.rlike(" " + "(?: | .* )".join(x.replace(".", "\\.") for x in rule) + " "), F.lit(name)) for rule, name in RULES]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    found = found.withColumn("names", F.array_sort(F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))))
    listed = F.concat(F.lit(","), F.array_join("names", ","))
    gone = F.array(*[F.when(listed.rlike(",(?:" + "|".join(by) + ")"), F.lit(name)) for name, by in BROADER.items()])
    return found.select("doc_id", F.array_join("ids", " ").alias("sentence_ids"), F.array_join(F.array_except("names", gone), ",").alias("licenses"), F.size("ids").cast("long").alias("n_sentences"))
