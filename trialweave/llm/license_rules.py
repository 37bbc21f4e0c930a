"""Signature rules for license texts, notices, tags and links.

Patterns run over a text's words (lower-cased A-Z, joined by single spaces,
everything else dropped), so "GPL-3.0-or-later" reads "gpl 3 0 or later". Each
license has hand-written patterns for its names, its identifiers, its links and
phrases of its body; the kinds below frame them. No pattern is open-ended: a
match has at most ``LONGEST`` words.
"""

from __future__ import annotations

import re
from typing import NamedTuple

LONGEST = 60


class Rule(NamedTuple):
    """One signature; ``gate`` has the words, separated by ``|``, of which each match holds one."""

    rule: int
    label: str
    kind: str
    gate: str
    pattern: str
    priority: int
    weight: float


#: Kind: priority (greater wins) and how sure a detection of it is.
KINDS = {"body": (6, 1.0), "tag": (5, 1.0), "notice": (4, 0.95), "link": (3, 0.9), "name": (2, 0.75), "base": (1, 0.6), "hint": (0, 0.3)}

#: The phrases that every scan counts, in the order of their labels.
BASE = (("apache", "apache license"), ("gpl", "general public license"), ("mit", "mit license"))

_V = r"(?: v| version)?"
_CC = r"(?:cc|creative commons(?: license)?) "

#: Label: gate word, names, identifiers, links, phrases of the body (each with its gate).
LICENSES: dict[str, tuple[str, str, str, str, tuple[tuple[str, str], ...]]] = {
    "mit": ("mit", r"mit(?: x11| expat)? licen[sc]e|x11 mit licen[sc]e", r"mit", r"opensource org licenses? mit", (("permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),)),
    "mit-0": ("mit", r"mit no attribution(?: license)?", r"mit 0", r"github com aws mit 0", ()),
    "apache-2.0": ("apache", rf"apache(?: software)? licen[sc]e,?{_V} v?2(?: 0)?|apache 2(?: 0)? licen[sc]e", r"apache 2 0", r"apache org licenses license 2 0", (("apache", r"you may not use this file except in compliance with the license you may obtain a copy of the license at (?:https? )?(?:www )?apache"),)),
    "apache-1.1": ("apache", rf"apache(?: software)? licen[sc]e{_V} v?1 1", r"apache 1 1", r"apache org licenses license 1 1", ()),
    "apache-1.0": ("apache", rf"apache(?: software)? licen[sc]e{_V} v?1 0", r"apache 1 0", r"apache org licenses license 1 0", ()),
    "gpl-1.0": ("general", rf"(?:gnu )?general public licen[sc]e{_V} v?1(?: 0)?", r"gpl 1 0(?: only| or later)?", r"gnu org licenses old licenses gpl 1 0", ()),
    "gpl-2.0": ("general", rf"(?:gnu )?general public licen[sc]e{_V} v?2(?: 0)?", r"gpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 2 0", (("gplv2", r"gplv2(?: or later)?"), ("gpl", r"gpl v2(?: or later)?"))),
    "gpl-3.0": ("general", rf"(?:gnu )?general public licen[sc]e{_V} v?3(?: 0)?", r"gpl 3 0(?: only| or later)?", r"gnu org licenses gpl 3 0", (("gplv3", r"gplv3(?: or later)?"),)),
    "lgpl-2.0": ("library", rf"(?:gnu )?library general public licen[sc]e(?:{_V} v?2(?: 0)?)?", r"lgpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 0", ()),
    "lgpl-2.1": ("lesser", rf"(?:gnu )?lesser general public licen[sc]e{_V} v?2 1", r"lgpl 2 1(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1", ()),
    "lgpl-3.0": ("lesser", rf"(?:gnu )?lesser general public licen[sc]e{_V} v?3(?: 0)?", r"lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0", (("lgplv3", r"lgplv3"),)),
    "lgpl": ("lesser", r"(?:gnu )?lesser general public licen[sc]e", r"lgpl", r"gnu org licenses lgpl", ()),
    "agpl-3.0": ("affero", rf"(?:gnu )?affero general public licen[sc]e(?:{_V} v?3(?: 0)?)?", r"agpl 3 0(?: only| or later)?", r"gnu org licenses agpl 3 0", (("agplv3", r"agplv3"),)),
    "gfdl": ("documentation", rf"(?:gnu )?free documentation licen[sc]e(?:{_V} v?1 [123])?", r"gfdl 1 [123](?: only| or later)?", r"gnu org licenses fdl(?: 1 [123])?", (("invariant", r"with no invariant sections no front cover texts and no back cover texts"),)),
    "bsd-2-clause": ("bsd", r"(?:simplified|freebsd) bsd licen[sc]e|(?:2|two) clause bsd licen[sc]e|bsd (?:2|two) clause(?: licen[sc]e)?", r"bsd 2 clause", r"opensource org licenses? bsd 2 clause", ()),
    "bsd-3-clause": ("bsd", r"(?:new|modified|revised) bsd licen[sc]e|(?:3|three) clause bsd licen[sc]e|bsd (?:3|three) clause(?: licen[sc]e)?", r"bsd 3 clause", r"opensource org licenses? bsd 3 clause", (("endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),)),
    "bsd-4-clause": ("bsd", r"original bsd licen[sc]e|(?:4|four) clause bsd licen[sc]e|bsd (?:4|four) clause(?: licen[sc]e)?", r"bsd 4 clause", r"spdx org licenses bsd 4 clause", (("acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),)),
    "0bsd": ("bsd", r"(?:zero|0) clause bsd(?: licen[sc]e)?|bsd zero clause licen[sc]e", r"0bsd", r"opensource org licenses? 0bsd", ()),
    "bsd": ("bsd", r"bsd(?: style)? licen[sc]e", r"bsd", r"opensource org licenses? bsd license(?: php)?", (("redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),)),
    "isc": ("isc", r"isc licen[sc]e", r"isc", r"opensource org licenses? isc", (("permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),)),
    "mpl-1.0": ("mozilla", rf"mozilla public licen[sc]e{_V} v?1 0", r"mpl 1 0", r"mozilla org mpl 1 0", ()),
    "mpl-1.1": ("mozilla", rf"mozilla public licen[sc]e{_V} v?1 1", r"mpl 1 1", r"mozilla org mpl 1 1", ()),
    "mpl-2.0": ("mozilla", rf"mozilla public licen[sc]e,?{_V} v?2(?: 0)?", r"mpl 2 0", r"mozilla org (?:en us )?mpl 2 0", (("mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),)),
    "epl-1.0": ("eclipse", rf"eclipse public licen[sc]e{_V} v?1 0", r"epl 1 0", r"eclipse org legal epl v10", ()),
    "epl-2.0": ("eclipse", rf"eclipse public licen[sc]e{_V} v?2 0", r"epl 2 0", r"eclipse org legal epl 2 0", ()),
    "edl-1.0": ("eclipse", rf"eclipse distribution licen[sc]e(?:{_V} v?1 0)?", r"edl 1 0", r"eclipse org org documents edl v10", ()),
    "cddl-1.0": ("distribution", rf"common development and distribution licen[sc]e{_V} v?1 0", r"cddl 1 0", r"opensource org licenses? cddl 1 0", ()),
    "cddl-1.1": ("distribution", rf"common development and distribution licen[sc]e{_V} v?1 1", r"cddl 1 1", r"oracle com (?:java )?cddl 1 1", ()),
    "cpl-1.0": ("common", rf"common public licen[sc]e(?:{_V} v?1 0)?", r"cpl 1 0", r"opensource org licenses? cpl1 0", ()),
    "cpal-1.0": ("attribution", r"common public attribution licen[sc]e", r"cpal 1 0", r"opensource org licenses? cpal 1 0", ()),
    "bsl-1.0": ("boost", rf"boost software licen[sc]e(?:{_V} v?1 0)?", r"bsl 1 0", r"boost org license 1 0", ()),
    "busl-1.1": ("business", rf"business source licen[sc]e(?:{_V} v?1 1)?", r"busl 1 1", r"mariadb com bsl11", ()),
    "artistic-1.0": ("artistic", rf"artistic licen[sc]e{_V} v?1 0", r"artistic 1 0(?: perl)?", r"opensource org licenses? artistic license 1 0", ()),
    "artistic-2.0": ("artistic", rf"artistic licen[sc]e{_V} v?2(?: 0)?", r"artistic 2 0", r"opensource org licenses? artistic license 2 0", ()),
    "zlib": ("zlib", r"zlib(?: libpng)? licen[sc]e", r"zlib", r"zlib net zlib license", (("warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),)),
    "libpng": ("libpng", r"libpng licen[sc]e", r"libpng(?: 2 0)?", r"libpng org pub png src libpng license", ()),
    "unlicense": ("unlicense", r"the unlicense", r"unlicense", r"unlicense org", (("unencumbered", r"this is free and unencumbered software released into the public domain"),)),
    "wtfpl": ("wtfpl", r"wtfpl(?: license)?", r"wtfpl", r"wtfpl net", (("fuck", r"do what the fuck you want to public license"),)),
    "python-2.0": ("python", r"python software foundation licen[sc]e|python licen[sc]e", r"python 2 0", r"docs python org (?:3 )?license", ()),
    "postgresql": ("postgresql", r"postgresql licen[sc]e", r"postgresql", r"postgresql org about licence", ()),
    "ruby": ("ruby", r"ruby licen[sc]e|same terms as ruby", r"ruby", r"ruby lang org en about license", ()),
    "perl": ("perl", r"same terms as perl(?: itself)?", r"artistic 1 0 or gpl 1 0", r"dev perl org licenses", ()),
    "php-3.0": ("php", rf"php licen[sc]e(?:{_V} v?3 0[01]?)?", r"php 3 0[01]?", r"php net license", ()),
    "openssl": ("openssl", r"openssl licen[sc]e", r"openssl", r"openssl org source license", ()),
    "curl": ("curl", r"curl licen[sc]e", r"curl", r"curl se docs copyright", ()),
    "ncsa": ("ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e", r"ncsa", r"otm illinois edu uiuc opensource", ()),
    "osl-3.0": ("open", rf"open software licen[sc]e(?:{_V} v?3 0)?", r"osl 3 0", r"opensource org licenses? osl 3 0", ()),
    "afl-3.0": ("academic", rf"academic free licen[sc]e(?:{_V} v?3 0)?", r"afl 3 0", r"opensource org licenses? afl 3 0", ()),
    "ecl-2.0": ("educational", r"educational community licen[sc]e", r"ecl 2 0", r"opensource org licenses? ecl 2 0", ()),
    "eupl-1.2": ("european", rf"european union public licen[sc]e(?:{_V} v?1 [12])?", r"eupl 1 [12]", r"joinup ec europa eu (?:software page )?eupl", ()),
    "ms-pl": ("microsoft", r"microsoft public licen[sc]e", r"ms pl", r"opensource org licenses? ms pl", ()),
    "ms-rl": ("microsoft", r"microsoft reciprocal licen[sc]e", r"ms rl", r"opensource org licenses? ms rl", ()),
    "ofl-1.1": ("sil", rf"sil open font licen[sc]e(?:{_V} v?1 1)?", r"ofl 1 1", r"scripts sil org ofl", ()),
    "odbl-1.0": ("database", rf"open (?:data commons open )?database licen[sc]e(?:{_V} v?1 0)?", r"odbl 1 0", r"opendatacommons org licenses odbl", ()),
    "odc-by-1.0": ("commons", r"open data commons attribution licen[sc]e", r"odc by 1 0", r"opendatacommons org licenses by", ()),
    "pddl-1.0": ("dedication", r"public domain dedication and licen[sc]e", r"pddl 1 0", r"opendatacommons org licenses pddl", ()),
    "cc0-1.0": ("cc0", rf"cc0(?:{_V} v?1 0)?(?: universal)?", r"cc0 1 0", r"creativecommons org publicdomain zero 1 0", (("waived", r"has waived all copyright and related or neighboring rights to"),)),
    "cc-by-4.0": ("cc|creative", _CC + r"(?:by|attribution) 4 0", r"cc by 4 0", r"creativecommons org licenses by 4 0", ()),
    "cc-by-3.0": ("cc|creative", _CC + r"(?:by|attribution) 3 0", r"cc by 3 0", r"creativecommons org licenses by 3 0", ()),
    "cc-by-2.0": ("cc|creative", _CC + r"(?:by|attribution) 2 [05]", r"cc by 2 [05]", r"creativecommons org licenses by 2 [05]", ()),
    "cc-by-sa-4.0": ("cc|creative", _CC + r"(?:by sa|attribution share ?alike) 4 0", r"cc by sa 4 0", r"creativecommons org licenses by sa 4 0", ()),
    "cc-by-sa-3.0": ("cc|creative", _CC + r"(?:by sa|attribution share ?alike) 3 0", r"cc by sa 3 0", r"creativecommons org licenses by sa 3 0", ()),
    "cc-by-nc-4.0": ("cc|creative", _CC + r"(?:by nc|attribution non ?commercial) 4 0", r"cc by nc 4 0", r"creativecommons org licenses by nc 4 0", ()),
    "cc-by-nc-3.0": ("cc|creative", _CC + r"(?:by nc|attribution non ?commercial) 3 0", r"cc by nc 3 0", r"creativecommons org licenses by nc 3 0", ()),
    "cc-by-nd-4.0": ("cc|creative", _CC + r"(?:by nd|attribution no ?derivatives) 4 0", r"cc by nd 4 0", r"creativecommons org licenses by nd 4 0", ()),
    "cc-by-nc-sa-4.0": ("cc|creative", _CC + r"(?:by nc sa|attribution non ?commercial share ?alike) 4 0", r"cc by nc sa 4 0", r"creativecommons org licenses by nc sa 4 0", ()),
    "cc-by-nc-nd-4.0": ("cc|creative", _CC + r"(?:by nc nd|attribution non ?commercial no ?derivatives) 4 0", r"cc by nc nd 4 0", r"creativecommons org licenses by nc nd 4 0", ()),
    "sspl-1.0": ("side", rf"server side public licen[sc]e(?:{_V} v?1)?", r"sspl 1 0", r"mongodb com licensing server side public license", ()),
    "elastic-2.0": ("elastic", rf"elastic licen[sc]e(?:{_V} v?2 0)?", r"elastic 2 0", r"elastic co licensing elastic license", ()),
    "public-domain": ("domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", r"licenseref public domain", r"creativecommons org publicdomain mark 1 0", (("domain", r"this (?:work|file|code|document) is (?:in|part of) the public domain"),)),
    "proprietary": ("proprietary", r"proprietary and confidential", r"licenseref proprietary", r"licenseref commercial", (("reserved", r"all rights reserved"), ("unauthorized", r"unauthorized (?:copying|reproduction|distribution) of this (?:file|document|work)(?: via any medium)? is strictly prohibited"))),
}

#: More phrases of license texts and of the notices that they ask for, each with its gate.
BODIES: dict[str, tuple[tuple[str, str], ...]] = {
    "mit-0": (("furnished", r"to whom the software is furnished to do so the software is provided as is"),),
    "apache-1.1": (("acknowledgment", r"acknowledgment this product includes software developed by the apache software foundation"),),
    "apache-1.0": (("apache", r"this product includes software developed by the apache group for use in the apache http server project"),),
    "apache-2.0": (("perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),),
    "mit": (("substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),),
    "gpl-1.0": (("foundation", r"gnu general public license as published by the free software foundation either version 1"),),
    "gpl-2.0": (("foundation", r"gnu general public license as published by the free software foundation either version 2"), ("activities", r"activities other than copying distribution and modification are not covered by this license")),
    "gpl-3.0": (("foundation", r"gnu general public license as published by the free software foundation either version 3"), ("propagate", r"to propagate a work means to do anything with it that without permission would make you directly or secondarily liable")),
    "lgpl-2.0": (("foundation", r"gnu library general public license as published by the free software foundation either version 2"),),
    "lgpl-2.1": (("foundation", r"gnu lesser general public license as published by the free software foundation either version 2 1"),),
    "lgpl-3.0": (("foundation", r"gnu lesser general public license as published by the free software foundation either version 3"),),
    "lgpl": (("library", r"a program that contains no derivative of any portion of the library but is designed to work with the library"),),
    "agpl-3.0": (("foundation", r"gnu affero general public license as published by the free software foundation either version 3"), ("remotely", r"all users interacting with it remotely through a computer network")),
    "bsd": (("redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),),
    "bsd-3-clause": (("neither", r"neither the name of the copyright holder nor the names of its contributors may be used"),),
    "0bsd": (("fee", r"for any purpose with or without fee is hereby granted the software is provided as is"),),
    "mpl-1.0": (("mozilla", r"the contents of this file are subject to the mozilla public license version 1 0"),),
    "mpl-1.1": (("mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),),
    "epl-1.0": (("eclipse", r"the accompanying program is provided under the terms of this eclipse public license"),),
    "epl-2.0": (("eclipse", r"the accompanying materials are made available under the terms of the eclipse public license 2 0"),),
    "edl-1.0": (("eclipse", r"neither the name of the eclipse foundation inc nor the names of its contributors may be used"),),
    "cddl-1.0": (("distribution", r"the contents of this file are subject to the terms of the common development and distribution license"),),
    "cpl-1.0": (("common", r"the accompanying program is provided under the terms of this common public license"),),
    "cpal-1.0": (("attribution", r"the contents of this file are subject to the common public attribution license version 1 0"),),
    "bsl-1.0": (("organization", r"to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),),
    "busl-1.1": (("licensor", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),),
    "artistic-1.0": (("semblance", r"such that the copyright holder maintains some semblance of artistic control"),),
    "artistic-2.0": (("establishes", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),),
    "libpng": (("png", r"the png reference library is supplied as is"),),
    "unlicense": (("dedicate", r"the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),),
    "python-2.0": (("psf", r"this license agreement is between the python software foundation psf and the individual or organization licensee"),),
    "postgresql": (("agreement", r"for any purpose without fee and without a written agreement is hereby granted"),),
    "ruby": (("verbatim", r"you may make and give away verbatim copies of the source form of the software without restriction"),),
    "perl": (("kit", r"the artistic license which comes with this kit"),),
    "php-3.0": (("php", r"this product includes php software freely available from"),),
    "openssl": (("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),),
    "curl": (("fee", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),),
    "ncsa": (("deal", r"to deal with the software without restriction including without limitation the rights"),),
    "osl-3.0": (("authorship", r"this open software license the license applies to any original work of authorship"),),
    "afl-3.0": (("authorship", r"this academic free license the license applies to any original work of authorship"),),
    "ecl-2.0": (("educational", r"licensed under the educational community license version 2 0 the license you may not use this file except in compliance"),),
    "eupl-1.2": (("eupl", r"licensed under the eupl version 1 [12] or as soon they will be approved by the european commission"),),
    "ms-pl": (("governs", r"this license governs use of the accompanying software if you use the software you accept this license"),),
    "ms-rl": (("recipients", r"you must provide recipients the source code to that file along with a copy of this license"),),
    "ofl-1.1": (("font", r"the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),),
    "odbl-1.0": (("odbl", r"the open database license odbl is a license agreement intended to allow users to freely share modify and use this database"),),
    "odc-by-1.0": (("commons", r"the open data commons attribution license is a license agreement intended to allow users to freely share modify and use this database"),),
    "pddl-1.0": (("dedication", r"public domain dedication and licen[sc]e is a document intended to allow you to freely share modify and use this work"),),
    "cc-by-4.0": (("creative", r"the terms and conditions of this creative commons attribution 4 0 international public license"),),
    "cc-by-3.0": (("creative", r"licensed under (?:a|the) creative commons attribution 3 0 (?:unported|united states) license"),),
    "cc-by-2.0": (("creative", r"licensed under (?:a|the) creative commons attribution 2 [05] (?:generic|unported) license"),),
    "cc-by-sa-4.0": (("creative", r"the terms and conditions of this creative commons attribution sharealike 4 0 international public license"),),
    "cc-by-sa-3.0": (("creative", r"licensed under (?:a|the) creative commons attribution share ?alike 3 0 (?:unported|united states) license"),),
    "cc-by-nc-4.0": (("creative", r"the terms and conditions of this creative commons attribution noncommercial 4 0 international public license"),),
    "cc-by-nc-3.0": (("creative", r"licensed under (?:a|the) creative commons attribution non ?commercial 3 0 (?:unported|united states) license"),),
    "cc-by-nd-4.0": (("creative", r"the terms and conditions of this creative commons attribution noderivatives 4 0 international public license"),),
    "cc-by-nc-sa-4.0": (("creative", r"the terms and conditions of this creative commons attribution noncommercial sharealike 4 0 international public license"),),
    "cc-by-nc-nd-4.0": (("creative", r"the terms and conditions of this creative commons attribution noncommercial noderivatives 4 0 international public license"),),
    "sspl-1.0": (("functionality", r"if you make the functionality of the program or a modified version available to third parties as a service"),),
    "elastic-2.0": (("hosted", r"you may not provide the software to third parties as a hosted or managed service"),),
}

#: How a notice introduces a license's name.
_NOTICE = r"(?:dual |re)?(?:licensed|released|distributed|published|available|provided|covered|made available)(?: to you)? (?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:gnu )?"
#: How a tag introduces an identifier.
_TAG = r"(?:spdx license identifier|license|licence|license expression)(?: is)? "
#: Words that hint at a license that no other rule knows.
_HINTS = (("unknown", "licensed", r"licensed (?:under|by)"), ("unknown", "copyleft", r"copyleft"), ("unknown", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}"))


def rules() -> list[Rule]:
    """All rules in order; an earlier rule goes before a later one of the same priority."""
    found: list[tuple[str, str, str, str]] = [(label, "base", phrase.split()[-2], phrase) for label, phrase in BASE]
    for label, (gate, names, ids, links, bodies) in LICENSES.items():
        first = re.match(r"[a-z0-9]+", ids)[0]
        found += [(label, "body", own, pattern) for own, pattern in (*bodies, *BODIES.get(label, ()))]
        found += [(label, "tag", first, _TAG + f"(?:{ids})"), (label, "notice", gate, _NOTICE + f"(?:{names})"), (label, "notice", first, _NOTICE + f"(?:{ids})")]
        found += [(label, "link", links.split()[0], links), (label, "name", gate, names)]
    found += [(label, "hint", gate, pattern) for label, gate, pattern in _HINTS]
    return [Rule(i, label, kind, gate, f"(?<= )(?:{pattern})(?= )", *KINDS[kind]) for i, (label, kind, gate, pattern) in enumerate(found)]
