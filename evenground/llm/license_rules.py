"""Signature rules for license notices: ordered, hand-written regular expressions, each behind a keyword.

A rule is a line ``label weight keyword: expression``. In an expression a blank stands for one or more characters that are no
word characters, and `` ?`` for none or more; expressions match whole words of the lower-case text. Of two detections over the same
place the rule that stands further up wins; one inside a longer detection is suppressed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: One or more of anything that is no word character, in the lower-case text.
GAP = r"[^0-9a-z\x80-\x{10FFFF}]+"
_EDGE = (r"(?<![0-9a-z\x80-\x{10FFFF}])", r"(?![0-9a-z\x80-\x{10FFFF}])")

_RULES = r"""
apache-2.0 1 spdx: spdx license identifier apache 2(?: 0)?
apache-1.1 1 spdx: spdx license identifier apache 1 1
apache-1.0 1 spdx: spdx license identifier apache 1(?: 0)?
agpl-3.0 1 spdx: spdx license identifier agpl 3(?: 0)?(?: only| or later)?
agpl-1.0 1 spdx: spdx license identifier agpl 1(?: 0)?(?: only| or later)?
lgpl-3.0 1 spdx: spdx license identifier lgpl 3(?: 0)?(?: only| or later)?
lgpl-2.1 1 spdx: spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.0 1 spdx: spdx license identifier lgpl 2(?: 0)?(?: only| or later)?
gpl-3.0 1 spdx: spdx license identifier gpl 3(?: 0)?(?: only| or later)?
gpl-2.0 1 spdx: spdx license identifier gpl 2(?: 0)?(?: only| or later)?
gpl-1.0 1 spdx: spdx license identifier gpl 1(?: 0)?(?: only| or later)?
gfdl-1.3 1 spdx: spdx license identifier gfdl 1 3(?: only| or later)?
gfdl-1.2 1 spdx: spdx license identifier gfdl 1 2(?: only| or later)?
mpl-2.0 1 spdx: spdx license identifier mpl 2(?: 0)?(?: no copyleft exception)?
mpl-1.1 1 spdx: spdx license identifier mpl 1 1
epl-2.0 1 spdx: spdx license identifier epl 2(?: 0)?
epl-1.0 1 spdx: spdx license identifier epl 1(?: 0)?
eupl-1.2 1 spdx: spdx license identifier eupl 1 2
cddl-1.0 1 spdx: spdx license identifier cddl 1(?: 0)?
bsd-2 1 spdx: spdx license identifier bsd 2 clause(?: patent)?
bsd-3 1 spdx: spdx license identifier bsd 3 clause(?: clear)?
bsd-4 1 spdx: spdx license identifier bsd 4 clause
0bsd 1 spdx: spdx license identifier 0bsd
mit-0 1 spdx: spdx license identifier mit 0
mit 1 spdx: spdx license identifier mit
isc 1 spdx: spdx license identifier isc
zlib 1 spdx: spdx license identifier zlib
bsl-1.0 1 spdx: spdx license identifier bsl 1(?: 0)?
busl-1.1 1 spdx: spdx license identifier busl 1 1
unlicense 1 spdx: spdx license identifier unlicense
wtfpl 1 spdx: spdx license identifier wtfpl
cc0 1 spdx: spdx license identifier cc0 1(?: 0)?
cc-by-4.0 1 spdx: spdx license identifier cc by 4(?: 0)?
cc-by-sa-4.0 1 spdx: spdx license identifier cc by sa 4(?: 0)?
artistic-2.0 1 spdx: spdx license identifier artistic 2(?: 0)?
ofl-1.1 1 spdx: spdx license identifier ofl 1 1
odbl-1.0 1 spdx: spdx license identifier odbl 1(?: 0)?
blueoak 1 spdx: spdx license identifier blueoak 1(?: 0){1,2}
spdx 0.7 spdx: spdx license identifier
cc-by-nc-nd-4.0 1 creativecommons: creativecommons org licenses by nc nd 4 0
cc-by-nc-sa-4.0 1 creativecommons: creativecommons org licenses by nc sa 4 0
cc-by-nc-4.0 1 creativecommons: creativecommons org licenses by nc 4 0
cc-by-nd-4.0 1 creativecommons: creativecommons org licenses by nd 4 0
cc-by-sa-4.0 1 creativecommons: creativecommons org licenses by sa 4 0
cc-by-4.0 1 creativecommons: creativecommons org licenses by 4 0
cc-by-nc-nd-3.0 1 creativecommons: creativecommons org licenses by nc nd 3 0
cc-by-nc-sa-3.0 1 creativecommons: creativecommons org licenses by nc sa 3 0
cc-by-nc-3.0 1 creativecommons: creativecommons org licenses by nc 3 0
cc-by-nd-3.0 1 creativecommons: creativecommons org licenses by nd 3 0
cc-by-sa-3.0 1 creativecommons: creativecommons org licenses by sa 3 0
cc-by-3.0 1 creativecommons: creativecommons org licenses by 3 0
cc-by-nc-sa-2.5 1 creativecommons: creativecommons org licenses by nc sa 2 5
cc-by-sa-2.5 1 creativecommons: creativecommons org licenses by sa 2 5
cc-by-2.5 1 creativecommons: creativecommons org licenses by 2 5
cc-by-sa-2.0 1 creativecommons: creativecommons org licenses by sa 2 0
cc-by-2.0 1 creativecommons: creativecommons org licenses by 2 0
cc-by-sa-1.0 1 creativecommons: creativecommons org licenses by sa 1 0
cc-by-1.0 1 creativecommons: creativecommons org licenses by 1 0
cc0 1 creativecommons: creativecommons org publicdomain zero 1 0
public-domain 0.95 creativecommons: creativecommons org publicdomain mark 1 0
cc 0.8 creativecommons: creativecommons org licenses
cc-by-nc-nd-4.0 0.95 creative: creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)? 4 0
cc-by-nc-sa-4.0 0.95 creative: creative commons attribution non ?commercial share ?alike 4 0
cc-by-nc-4.0 0.95 creative: creative commons attribution non ?commercial 4 0
cc-by-nd-4.0 0.95 creative: creative commons attribution no ?deriv(?:ative)?s(?: works)? 4 0
cc-by-sa-4.0 0.95 creative: creative commons attribution share ?alike 4 0
cc-by-4.0 0.95 creative: creative commons attribution 4 0
cc-by-nc-nd-3.0 0.95 creative: creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)? 3 0
cc-by-nc-sa-3.0 0.95 creative: creative commons attribution non ?commercial share ?alike 3 0
cc-by-nc-3.0 0.95 creative: creative commons attribution non ?commercial 3 0
cc-by-nd-3.0 0.95 creative: creative commons attribution no ?deriv(?:ative)?s(?: works)? 3 0
cc-by-sa-3.0 0.95 creative: creative commons attribution share ?alike 3 0
cc-by-3.0 0.95 creative: creative commons attribution 3 0
cc-by-sa-2.5 0.95 creative: creative commons attribution share ?alike 2 5
cc-by-2.5 0.95 creative: creative commons attribution 2 5
cc-by-sa-2.0 0.95 creative: creative commons attribution share ?alike 2 0
cc-by-2.0 0.95 creative: creative commons attribution 2 0
cc-by-nc-nd-4.0 0.95 cc: cc by nc nd 4(?: 0)?
cc-by-nc-sa-4.0 0.95 cc: cc by nc sa 4(?: 0)?
cc-by-nc-4.0 0.95 cc: cc by nc 4(?: 0)?
cc-by-nd-4.0 0.95 cc: cc by nd 4(?: 0)?
cc-by-sa-4.0 0.95 cc: cc by sa 4(?: 0)?
cc-by-4.0 0.95 cc: cc by 4(?: 0)?
cc-by-nc-nd-3.0 0.95 cc: cc by nc nd 3(?: 0)?
cc-by-nc-sa-3.0 0.95 cc: cc by nc sa 3(?: 0)?
cc-by-nc-3.0 0.95 cc: cc by nc 3(?: 0)?
cc-by-nd-3.0 0.95 cc: cc by nd 3(?: 0)?
cc-by-sa-3.0 0.95 cc: cc by sa 3(?: 0)?
cc-by-3.0 0.95 cc: cc by 3(?: 0)?
cc-by-nc-sa-2.5 0.95 cc: cc by nc sa 2 5
cc-by-sa-2.5 0.95 cc: cc by sa 2 5
cc-by-2.5 0.95 cc: cc by 2 5
cc-by-sa-2.0 0.95 cc: cc by sa 2(?: 0)?
cc-by-2.0 0.95 cc: cc by 2(?: 0)?
cc-by-sa-1.0 0.95 cc: cc by sa 1(?: 0)?
cc-by-1.0 0.95 cc: cc by 1(?: 0)?
cc0 0.95 cc0: cc0 1(?: 0)?(?: universal)?
apache-2.0 0.95 apache: licensed under (?:the )?(?:terms of the )?apache licen[cs]e (?:version |v ?)?2(?: 0)?
apache-2.0 0.9 apache: apache (?:software )?(?:foundation )?licen[cs]e (?:version |v ?)?2(?: 0)?
apache-1.1 0.9 apache: apache (?:software )?licen[cs]e (?:version |v ?)?1 1
apache-1.0 0.9 apache: apache (?:software )?licen[cs]e (?:version |v ?)?1(?: 0)?
apache-2.0 1 apache: (?:https? )?www apache org licenses license 2 0(?: txt| html)?
agpl-3.0 0.9 affero: (?:gnu )?affero general public licen[cs]e (?:version |v ?)?3(?: 0)?(?: or (?:any )?later(?: version)?)?
agpl-1.0 0.9 affero: (?:gnu )?affero general public licen[cs]e (?:version |v ?)?1(?: 0)?
lgpl-3.0 0.9 lesser: (?:gnu )?lesser general public licen[cs]e (?:version |v ?)?3(?: 0)?(?: or (?:any )?later(?: version)?)?
lgpl-2.1 0.9 lesser: (?:gnu )?lesser general public licen[cs]e (?:version |v ?)?2 1(?: or (?:any )?later(?: version)?)?
lgpl-2.0 0.9 lesser: (?:gnu )?lesser general public licen[cs]e (?:version |v ?)?2(?: 0)?
lgpl-2.0 0.9 library: (?:gnu )?library general public licen[cs]e (?:version |v ?)?2(?: 0)?
gpl-3.0 0.9 general: (?:gnu )?general public licen[cs]e (?:version |v ?)?3(?: 0)?(?: or (?:any )?later(?: version)?)?
gpl-2.0 0.9 general: (?:gnu )?general public licen[cs]e (?:version |v ?)?2(?: 0)?(?: or (?:any )?later(?: version)?)?
gpl-1.0 0.9 general: (?:gnu )?general public licen[cs]e (?:version |v ?)?1(?: 0)?
gfdl-1.3 0.9 documentation: (?:gnu )?free documentation licen[cs]e (?:version |v ?)?1 3
gfdl-1.2 0.9 documentation: (?:gnu )?free documentation licen[cs]e (?:version |v ?)?1 2
gfdl-1.1 0.9 documentation: (?:gnu )?free documentation licen[cs]e (?:version |v ?)?1 1
mpl-2.0 0.9 mozilla: mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?
mpl-1.1 0.9 mozilla: mozilla public licen[cs]e (?:version |v ?)?1 1
mpl-1.0 0.9 mozilla: mozilla public licen[cs]e (?:version |v ?)?1(?: 0)?
mpl-2.0 1 mozilla: (?:https? )?mozilla org mpl 2 0
epl-2.0 0.9 eclipse: eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?
epl-1.0 0.9 eclipse: eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?
edl-1.0 0.9 eclipse: eclipse distribution licen[cs]e (?:version |v ?)?1(?: 0)?
cddl-1.1 0.9 distribution: common development and distribution licen[cs]e (?:version |v ?)?1 1
cddl-1.0 0.9 distribution: common development and distribution licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
cpl-1.0 0.9 common: common public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
cpal-1.0 0.9 common: common public attribution licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
eupl-1.2 0.9 european: european union public licen[cs]e (?:version |v ?)?1 2
eupl-1.1 0.9 european: european union public licen[cs]e (?:version |v ?)?1 1
eupl 0.85 european: european union public licen[cs]e
afl-3.0 0.9 academic: academic free licen[cs]e (?:version |v ?)?3(?: 0)?
afl-2.1 0.9 academic: academic free licen[cs]e (?:version |v ?)?2 1
afl 0.85 academic: academic free licen[cs]e
osl-3.0 0.9 open: open software licen[cs]e (?:version |v ?)?3(?: 0)?
osl-2.1 0.9 open: open software licen[cs]e (?:version |v ?)?2 1
osl 0.8 open: open software licen[cs]e
artistic-2.0 0.9 artistic: artistic licen[cs]e (?:version |v ?)?2(?: 0)?
artistic-1.0 0.9 artistic: artistic licen[cs]e (?:version |v ?)?1(?: 0)?
artistic 0.8 artistic: artistic licen[cs]e
ecl-2.0 0.9 educational: educational community licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?
bsl-1.0 0.9 boost: boost software licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
busl-1.1 0.9 business: business source licen[cs]e(?: (?:version |v ?)?1 1)?
sspl-1.0 0.9 server: server side public licen[cs]e(?: (?:version |v ?)?1)?
elastic-2.0 0.9 elastic: elastic licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?
ms-pl 0.9 microsoft: microsoft public licen[cs]e
ms-rl 0.9 microsoft: microsoft reciprocal licen[cs]e
php-3.01 0.9 php: php licen[cs]e (?:version |v ?)?3 0?1
php-3.0 0.9 php: php licen[cs]e (?:version |v ?)?3(?: 0)?
php 0.8 php: php licen[cs]e
psf-2 0.9 python: python software foundation licen[cs]e(?: (?:version |v ?)?2)?
python 0.8 python: python licen[cs]e
zpl-2.1 0.9 zope: zope public licen[cs]e (?:version |v ?)?2 1
zpl-2.0 0.9 zope: zope public licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?
ofl-1.1 0.9 open: sil open font licen[cs]e (?:version |v ?)?1 1
ofl 0.85 open: (?:sil )?open font licen[cs]e
odbl-1.0 0.9 database: open (?:data commons )?(?:open )?database licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
odc-by 0.9 data: open data commons attribution licen[cs]e
pddl 0.9 domain: public domain dedication and licen[cs]e
ogl-3.0 0.9 government: open government licen[cs]e(?: canada| (?:version |v ?)?3(?: 0)?)?
sleepycat 0.9 sleepycat: sleepycat (?:public )?licen[cs]e
qpl-1.0 0.9 licen: q public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
ipl-1.0 0.9 ibm: ibm public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
watcom-1.0 0.9 watcom: (?:sybase )?open watcom public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
apsl-2.0 0.9 apple: apple public source licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?
nasa-1.3 0.9 nasa: nasa open source agreement(?: (?:version |v ?)?1 3)?
upl-1.0 0.9 universal: universal permissive licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
cecill-2.1 0.9 cecill: cecill (?:free software licen[cs]e )?(?:agreement )?(?:version |v ?)?2 1
cecill 0.8 cecill: cecill(?: [bc])? (?:free software )?licen[cs]e
vim 0.85 vim: vim licen[cs]e
curl 0.85 curl: curl licen[cs]e
openssl 0.85 openssl: openssl licen[cs]e
openldap 0.85 openldap: openldap public licen[cs]e
ntp 0.8 ntp: ntp licen[cs]e
icu 0.8 icu: icu licen[cs]e
unicode 0.85 unicode: unicode licen[cs]e(?: agreement)?
w3c 0.85 w3c: w3c software (?:and document )?(?:notice and )?licen[cs]e
x11 0.85 x11: x11 licen[cs]e
postgresql 0.85 postgresql: postgresql licen[cs]e
ruby 0.8 ruby: ruby licen[cs]e
perl 0.8 perl: same terms as perl(?: 5)?(?: itself)?
libpng 0.85 libpng: (?:zlib )?libpng licen[cs]e
zlib 0.85 zlib: zlib licen[cs]e
wtfpl 0.9 wtf: wtf public licen[cs]e
bsd-3 0.9 bsd: (?:3|three) clause bsd licen[cs]e
bsd-2 0.9 bsd: (?:2|two) clause bsd licen[cs]e
bsd-3 0.9 bsd: (?:new|revised|modified) bsd licen[cs]e
bsd-2 0.9 bsd: (?:simplified|free) bsd licen[cs]e
bsd-4 0.9 bsd: (?:original|old|(?:4|four) clause) bsd licen[cs]e
bsd-3 0.9 bsd: bsd (?:3|three) clause(?: licen[cs]e)?
bsd-2 0.9 bsd: bsd (?:2|two) clause(?: licen[cs]e)?
bsd 0.9 bsd: (?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?bsd licen[cs]e
bsd 0.8 bsd: bsd (?:style )?licen[cs]e
mit 0.9 licen: (?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?(?:mit|expat) licen[cs]e
mit-0 0.85 licen: mit no attribution(?: licen[cs]e)?
mit 0.8 licen: mit (?:style )?licen[cs]e
mit 0.8 expat: expat licen[cs]e
isc 0.8 licen: isc licen[cs]e
unlicense 0.85 unlicense: (?:the )?unlicense
apache 0.9 apache: (?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?apache licen[cs]e
apache 0.8 apache: apache (?:software )?licen[cs]e
agpl 0.8 affero: (?:gnu )?affero general public licen[cs]e
lgpl 0.8 lesser: (?:gnu )?lesser general public licen[cs]e
lgpl 0.8 library: (?:gnu )?library general public licen[cs]e
gpl 0.8 general: gnu general public licen[cs]e
gfdl 0.8 documentation: (?:gnu )?free documentation licen[cs]e
mpl 0.8 mozilla: mozilla public licen[cs]e
epl 0.8 eclipse: eclipse public licen[cs]e
cc-by-nc-nd 0.8 creative: creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nc-sa 0.8 creative: creative commons attribution non ?commercial share ?alike
cc-by-nc 0.8 creative: creative commons attribution non ?commercial
cc-by-nd 0.8 creative: creative commons attribution no ?deriv(?:ative)?s
cc-by-sa 0.8 creative: creative commons attribution share ?alike
cc-by 0.8 creative: creative commons attribution
cc-by-nc-nd 0.8 cc: cc by nc nd
cc-by-nc-sa 0.8 cc: cc by nc sa
cc-by-nc 0.8 cc: cc by nc
cc-by-nd 0.8 cc: cc by nd
cc-by-sa 0.8 cc: cc by sa
cc-by 0.7 cc: cc by
cc 0.7 creative: creative commons licen[cs]e
agpl-3.0 0.75 agpl: agpl ?(?:version |v ?)?3(?: 0)?
lgpl-3.0 0.75 lgpl: lgpl ?(?:version |v ?)?3(?: 0)?
lgpl-2.1 0.75 lgpl: lgpl ?(?:version |v ?)?2 1
lgpl-2.0 0.75 lgpl: lgpl ?(?:version |v ?)?2(?: 0)?
gpl-3.0 0.75 gpl: gpl ?(?:version |v ?)?3(?: 0)?
gpl-2.0 0.75 gpl: gpl ?(?:version |v ?)?2(?: 0)?
gfdl-1.3 0.75 gfdl: gfdl ?(?:version |v ?)?1 3
mpl-2.0 0.75 mpl: mpl ?(?:version |v ?)?2(?: 0)?
mpl-1.1 0.75 mpl: mpl ?(?:version |v ?)?1 1
epl-2.0 0.75 epl: epl ?(?:version |v ?)?2(?: 0)?
epl-1.0 0.75 epl: epl ?(?:version |v ?)?1(?: 0)?
eupl-1.2 0.75 eupl: eupl ?(?:version |v ?)?1 2
cddl-1.0 0.75 cddl: cddl ?(?:version |v ?)?1(?: 0)?
odbl-1.0 0.75 odbl: odbl ?(?:version |v ?)?1(?: 0)?
ofl-1.1 0.75 ofl: ofl ?(?:version |v ?)?1 1
apache-2.0 0.75 apache: apache ?(?:version |v ?)?2 0
wtfpl 0.75 wtfpl: wtfpl ?(?:version |v ?)?[12]
mit 0.95 permission: permission is hereby granted free of charge to any person obtaining a copy
isc 0.95 permission: permission to use copy modify and or distribute this software for any purpose
hpnd 0.9 permission: permission to use copy modify and distribute this software and its documentation
bsd 0.95 redistribution: redistribution and use in source and binary forms with or without modification are permitted
bsd-4 0.95 advertising: all advertising materials mentioning features or use of this software
bsd-3 0.9 endorse: may be used to endorse or promote products derived from this software
unlicense 0.95 unencumbered: this is free and unencumbered software released into the public domain
gpl 0.9 redistribute: this program is free software you can redistribute it and or modify it
lgpl 0.9 redistribute: this library is free software you can redistribute it and or modify it
zlib 0.8 warrant: this software is provided as is without any express or implied warranty
beerware 0.9 beer: you can buy me a beer in return
warranty 0.6 warrant: without warranty of any kind
warranty 0.6 warrant: without warranties or conditions of any kind
warranty 0.6 merchantability: implied warrant(?:y|ies) of merchantability
public-domain 0.8 domain: released into the public domain
public-domain 0.8 domain: dedicated to the public domain
public-domain 0.7 domain: (?:in|to) the public domain
copyright 0.5 copyright: copyright c(?: [0-9]{4})?
copyright 0.5 copyright: copyright [0-9]{4}
copyright 0.6 reserved: all rights reserved worldwide
copyright 0.6 reserved: some rights reserved
proprietary 0.7 confidential: proprietary and confidential
"""

#: Keywords that open a text's scan wherever they occur; the others occur with "licen" or in the two expressions of ``gate``.
_STRONG = "licen spdx creative permission redistribut unencumbered advertising endorse warrant beer domain copyright reserved confidential merchantability cc0 nasa apache mozilla".split()


@dataclass(frozen=True)
class Rule:
    """``keyword``: text that must occur before the regex is tried; of equal spans the smaller ``priority`` wins."""

    label: str
    weight: float
    keyword: str
    regex: str
    priority: int


def expression(words: str) -> str:
    """The regular expression of a rule's expression."""
    return f"{_EDGE[0]}(?:{words.replace(' ?', f'(?:{GAP})?').replace(' ', GAP)}){_EDGE[1]}"


def rules() -> list[Rule]:
    """All rules in order."""
    made = []
    for priority, line in enumerate(_RULES.strip().splitlines()):
        label, weight, rest = line.split(" ", 2)
        keyword, words = rest.split(": ", 1)
        made.append(Rule(label, float(weight), keyword, expression(words), priority))
    return made


def gate() -> tuple[list[str], str, str]:
    """(texts, regex before a digit, regex after "cc"): lower-case texts that none of the three is found in match no rule.

    Every rule has one of the texts in each match, or a short name before a number, or "cc" before "by".
    """
    gap = r"[^0-9a-z\x80-\x{10FFFF}]"
    short = re.findall(r"^\S+ \S+ (\w+): \1 \?\(\?:version", _RULES, re.M)
    bsd = f"bsd{gap}+(?:[23]|two|three)"
    named = f"(?:{'|'.join(sorted(set(short)))}){gap}*(?:version{gap}+|v{gap}*)?[0-9]|{bsd}|cecill|mit{gap}+no|terms{gap}+as{gap}+perl"
    return _STRONG, f"{_EDGE[0]}(?:{named})", f"{_EDGE[0]}cc{gap}+by"
