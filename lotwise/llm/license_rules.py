"""Signature rules of licenses: hand-written patterns over normalised words.

A text is normalised to its lower-case words (letters and digits), joined by one
space, so ``GPL-3.0-or-later`` reads ``gpl 3 0 or later`` and an address reads as
its parts.  A pattern covers whole words.  Every line below is one rule: label,
kind, keyword, pattern.  The keyword is a literal that every match contains; a
text without it is never given to the pattern.  The kind sets the rule's priority
(``KINDS``); of rules of one kind the earlier line comes first.
"""

from __future__ import annotations

# ---- fixed values: kinds of rules in order of priority, with their confidence ----
KINDS = {
    "tag": 1.0,         # machine-readable identifier
    "text": 0.95,       # a passage of the license's own text
    "grant": 0.9,       # a statement that names the license
    "url": 0.85,        # the license's address
    "name": 0.7,        # the license's name with a version
    "plain": 0.5,       # the name alone
    "hint": 0.2,        # rights statements that name no license
}

# ---- fixed values: the rules; ~ stands for up to six words ----
RULES = r"""
apache-2.0 | tag | license identifier apache | spdx license identifier apache 2 0
apache-1.1 | tag | license identifier apache | spdx license identifier apache 1 1
mit | tag | license identifier mit | spdx license identifier mit
mit-0 | tag | license identifier mit | spdx license identifier mit 0
bsd-2-clause | tag | license identifier bsd | spdx license identifier bsd 2 clause(?: patent)?
bsd-3-clause | tag | license identifier bsd | spdx license identifier bsd 3 clause(?: clear)?
bsd-4-clause | tag | license identifier bsd | spdx license identifier bsd 4 clause
0bsd | tag | license identifier 0bsd | spdx license identifier 0bsd
gpl-2.0-only | tag | license identifier gpl | spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later | tag | license identifier gpl | spdx license identifier gpl 2 0 or later
gpl-3.0-only | tag | license identifier gpl | spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later | tag | license identifier gpl | spdx license identifier gpl 3 0 or later
lgpl-2.1-only | tag | license identifier lgpl | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later | tag | license identifier lgpl | spdx license identifier lgpl 2 1 or later
lgpl-3.0-only | tag | license identifier lgpl | spdx license identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later | tag | license identifier lgpl | spdx license identifier lgpl 3 0 or later
agpl-3.0-only | tag | license identifier agpl | spdx license identifier agpl 3 0(?: only)?
agpl-3.0-or-later | tag | license identifier agpl | spdx license identifier agpl 3 0 or later
mpl-2.0 | tag | license identifier mpl | spdx license identifier mpl 2 0
mpl-1.1 | tag | license identifier mpl | spdx license identifier mpl 1 1
epl-1.0 | tag | license identifier epl | spdx license identifier epl 1 0
epl-2.0 | tag | license identifier epl | spdx license identifier epl 2 0
isc | tag | license identifier isc | spdx license identifier isc
zlib | tag | license identifier zlib | spdx license identifier zlib
unlicense | tag | license identifier unlicense | spdx license identifier unlicense
bsl-1.0 | tag | license identifier bsl | spdx license identifier bsl 1 0
busl-1.1 | tag | license identifier busl | spdx license identifier busl 1 1
cc0-1.0 | tag | license identifier cc0 | spdx license identifier cc0 1 0
cc-by-4.0 | tag | license identifier cc by | spdx license identifier cc by 4 0
cc-by-sa-4.0 | tag | license identifier cc by | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | tag | license identifier cc by | spdx license identifier cc by nc 4 0
wtfpl | tag | license identifier wtfpl | spdx license identifier wtfpl
artistic-2.0 | tag | license identifier artistic | spdx license identifier artistic 2 0
ofl-1.1 | tag | license identifier ofl | spdx license identifier ofl 1 1
cddl-1.0 | tag | license identifier cddl | spdx license identifier cddl 1 0
python-2.0 | tag | license identifier psf | spdx license identifier psf 2 0
eupl-1.2 | tag | license identifier eupl | spdx license identifier eupl 1 2
odbl-1.0 | tag | license identifier odbl | spdx license identifier odbl 1 0
mit | text | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | text | substantial portions of the software | (?:the above copyright notice and )?this permission notice shall be included in all copies or substantial portions of the software
mit | text | without restriction | to deal in the software without restriction
x11 | text | used in advertising or otherwise to promote | shall not be used in advertising or otherwise to promote the sale use or other dealings
isc | text | with or without fee is hereby granted | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
bsd | text | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | text | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | text | endorse or promote products | (?:neither the name|the names?) ~ may(?: not)? be used to endorse or promote products
bsd-4-clause | text | advertising materials | all advertising materials mentioning features or use of this software must display
apache-2.0 | text | compliance with the license | you may not use this file except in compliance with the license
apache-2.0 | text | perpetual worldwide non exclusive no charge | grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable
apache-2.0 | text | on an as is basis | distributed on an as is basis without warranties or conditions of any kind
gpl | text | free software you can redistribute | (?:this (?:program|library|file)|it) is free software you can redistribute it and or modify it
gpl | text | under the terms of the gnu | under the terms of the gnu general public license as published by the free software foundation
lgpl | text | general public license | under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation
agpl | text | affero general public license | under the terms of the gnu affero general public license as published by the free software foundation
gpl-or-later | text | at your option any later version | (?:either )?version [23](?: [01])?(?: of the license)? or at your option any later version
gpl | text | received a copy of the gnu | you should have received a copy of the gnu general public license
lgpl | text | received a copy of the gnu lesser | you should have received a copy of the gnu lesser general public license
agpl | text | received a copy of the gnu affero | you should have received a copy of the gnu affero general public license
mpl-2.0 | text | subject to the terms of the mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | text | subject to the mozilla | the contents of this file are subject to the mozilla public license version 1 1
epl | text | accompanying materials are made available | this program and the accompanying materials are made available under the terms of the eclipse public license
cddl-1.0 | text | common development and distribution license | subject to the terms of the common development and distribution license
zlib | text | must not be misrepresented | the origin of this software must not be misrepresented
zlib | text | altered source versions | altered source versions must be plainly marked as such
bsl-1.0 | text | obtaining a copy of the software and accompanying | granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | text | unencumbered software | this is free and unencumbered software released into the public domain
wtfpl | text | do what the | you just do what the \S+ you want to
beerware | text | buy me a beer | you can buy me a beer in return
cc0-1.0 | text | neighboring rights | waive[ds]? all copyright and related ~ neighboring rights
cc-by | text | share copy and redistribute the material | share copy and redistribute the material in any medium or format
cc-sa | text | under the same license as the original | distribute your contributions under the same license as the original
cc-nc | text | material for commercial purposes | you may not use the material for commercial purposes
cc-nd | text | distribute the modified material | you may not distribute the modified material
artistic | text | original package | you may (?:copy|distribute)(?: and (?:copy|distribute))? ~ original package
ofl-1.1 | text | reserved font name | no modified version of the font software may use the reserved font name
postgresql | text | without a written agreement | without fee and without a written agreement is hereby granted
openssl | text | openssl toolkit | for use in the openssl toolkit
php-3.01 | text | this product includes php | this product includes php software
proprietary | text | unauthorized copying | unauthorized copying of this (?:file|software|document) ~ (?:is )?(?:strictly )?prohibited
proprietary | text | trade secret | (?:contains?|constitutes?) (?:confidential|proprietary|trade secrets?) ~ trade secrets? of
proprietary | text | no part of this | no part of this (?:publication|book|document|work|site) may be reproduced
proprietary | text | may not be | may not be (?:copied )?(?:reproduced|reproduced or transmitted) ~ without (?:the )?(?:prior )?(?:written|express) (?:permission|consent)
proprietary | text | prior written permission | without (?:the )?prior written permission of the (?:publisher|copyright owner|copyright holder|author)
personal-use | text | use only | for (?:your )?personal(?: and)?(?: non commercial| private)? use only
personal-use | text | non commercial use only | for (?:personal )?non commercial use only
apache-2.0 | grant | apache license | (?:licensed|released|distributed|available|published) under(?: the terms of)?(?: the)? apache license(?: version)? 2(?: 0)?
apache-2.0 | grant | apache 2 | (?:licensed|released|distributed|available|published) under(?: the terms of)?(?: the)? apache 2(?: 0)?(?: license)?
apache-1.1 | grant | apache software license | (?:licensed|released|distributed) under the apache software license version 1 1
mit | grant | mit license | (?:licensed|released|distributed|available|published) under(?: the terms of)?(?: the| an)? mit license
mit | grant | mit licence | (?:licensed|released|distributed|available|published) under(?: the terms of)?(?: the| an)? mit licence
bsd | grant | bsd license | (?:licensed|released|distributed|available|published) under(?: the terms of)?(?: the| a)? bsd license
bsd-2-clause | grant | 2 clause bsd | (?:licensed|released|distributed|available|published) under(?: the| a)? 2 clause bsd license
bsd-3-clause | grant | 3 clause bsd | (?:licensed|released|distributed|available|published) under(?: the| a)? 3 clause bsd license
gpl-2.0 | grant | general public license | (?:licensed|released|distributed|available|published) under(?: the terms of)?(?: the)?(?: gnu)? general public license(?: gpl)? (?:version |v ?)?2(?: 0)?
gpl-3.0 | grant | general public license | (?:licensed|released|distributed|available|published) under(?: the terms of)?(?: the)?(?: gnu)? general public license(?: gpl)? (?:version |v ?)?3(?: 0)?
gpl | grant | general public license | (?:licensed|released|distributed|available|published) under(?: the terms of)?(?: the)?(?: gnu)? general public license
lgpl-2.1 | grant | lesser general public license | (?:licensed|released|distributed|available) under(?: the terms of)?(?: the)?(?: gnu)? lesser general public license(?: lgpl)? (?:version |v ?)?2 1
lgpl-3.0 | grant | lesser general public license | (?:licensed|released|distributed|available) under(?: the terms of)?(?: the)?(?: gnu)? lesser general public license(?: lgpl)? (?:version |v ?)?3(?: 0)?
lgpl | grant | lesser general public license | (?:licensed|released|distributed|available) under(?: the terms of)?(?: the)?(?: gnu)? lesser general public license
agpl-3.0 | grant | affero general public license | (?:licensed|released|distributed|available) under(?: the terms of)?(?: the)?(?: gnu)? affero general public license(?: agpl)?(?: (?:version |v ?)?3(?: 0)?)?
gpl | grant | the gpl | (?:licensed|released|distributed|available) under(?: the terms of)? the gpl
mpl-2.0 | grant | mozilla public license | (?:licensed|released|distributed|available) under(?: the terms of)?(?: the)? mozilla public license(?: mpl)? (?:version |v ?)?2(?: 0)?
mpl | grant | mozilla public license | (?:licensed|released|distributed|available) under(?: the terms of)?(?: the)? mozilla public license
epl-2.0 | grant | eclipse public license | (?:licensed|released|distributed|available) under(?: the terms of)?(?: the)? eclipse public license(?: epl)? (?:version |v ?)?2(?: 0)?
epl-1.0 | grant | eclipse public license | (?:licensed|released|distributed|available) under(?: the terms of)?(?: the)? eclipse public license(?: epl)? (?:version |v ?)?1(?: 0)?
cddl | grant | common development and distribution | (?:licensed|released|distributed|available) under(?: the terms of)?(?: the)? common development and distribution license
isc | grant | isc license | (?:licensed|released|distributed|available) under(?: the terms of)?(?: the| an)? isc license
zlib | grant | zlib license | (?:licensed|released|distributed|available) under(?: the terms of)?(?: the)? zlib license
bsl-1.0 | grant | boost software license | (?:licensed|released|distributed|available) under(?: the terms of)?(?: the)? boost software license
artistic | grant | artistic license | (?:licensed|released|distributed|available) under(?: the terms of)?(?: the)? artistic license
perl | grant | same terms as perl | under the same terms as perl(?: itself)?
cc-by-nc-nd | grant | cc by nc nd | (?:licensed|released|distributed|available|published|shared) under(?: a| the)? cc by nc nd(?: (?:1|2|3|4) \d)?
cc-by-nc-sa | grant | cc by nc sa | (?:licensed|released|distributed|available|published|shared) under(?: a| the)? cc by nc sa(?: (?:1|2|3|4) \d)?
cc-by-nc | grant | cc by nc | (?:licensed|released|distributed|available|published|shared) under(?: a| the)? cc by nc(?: (?:1|2|3|4) \d)?
cc-by-nd | grant | cc by nd | (?:licensed|released|distributed|available|published|shared) under(?: a| the)? cc by nd(?: (?:1|2|3|4) \d)?
cc-by-sa | grant | cc by sa | (?:licensed|released|distributed|available|published|shared) under(?: a| the)? cc by sa(?: (?:1|2|3|4) \d)?
cc-by | grant | cc by | (?:licensed|released|distributed|available|published|shared) under(?: a| the)? cc by(?: (?:1|2|3|4) \d)?
cc0-1.0 | grant | cc0 | (?:licensed|released|distributed|available|published|dedicated) (?:under|to)(?: the)? cc0(?: 1 0)?
cc-by-nc-nd | grant | creative commons attribution | under(?: a| the)? creative commons attribution non ?commercial no ?deriv(?:s|atives?)
cc-by-nc-sa | grant | creative commons attribution | under(?: a| the)? creative commons attribution non ?commercial share ?alike
cc-by-nc | grant | creative commons attribution | under(?: a| the)? creative commons attribution non ?commercial
cc-by-nd | grant | creative commons attribution | under(?: a| the)? creative commons attribution no ?deriv(?:s|atives?)
cc-by-sa | grant | creative commons attribution | under(?: a| the)? creative commons attribution share ?alike
cc-by | grant | creative commons attribution | under(?: a| the)? creative commons attribution(?: (?:1|2|3|4) \d)?(?: \S+)? license
public-domain | grant | public domain | (?:released|placed|dedicated|donated) (?:in|into|to) the public domain
public-domain | grant | public domain | (?:this|the) (?:work|text|file|software|document) is in the public domain
unlicense | grant | unlicense | (?:licensed|released|distributed|available) under the unlicense
dual | grant | dual licensed | dual licensed under ~ and \S+
ogl-uk | grant | open government licen | (?:licensed|available|contains \S+ \S+ information licensed) under the open government licen[cs]e(?: v ?\d(?: \d)?)?
odbl | grant | open database license | (?:licensed|made available) under the open database license
gfdl | grant | free documentation license | under the terms of the gnu free documentation license(?: version 1 [123])?
openrail | grant | openrail | (?:licensed|released|available) under(?: the)?(?: \S+){0,3} openrail(?: m)?(?: license)?
llama | grant | community license | under the llama (?:\d )?(?:\d )?community license
busl | grant | business source license | under(?: the)? business source license(?: 1 1)?
sspl | grant | server side public license | under(?: the)? server side public license
elastic-2.0 | grant | elastic license | under(?: the)? elastic license(?: 2 0)?
commons-clause | grant | commons clause | commons clause license condition
apache-2.0 | url | apache org licenses | (?:https? )?(?:www )?apache org licenses license 2 0(?: (?:html|txt))?
mit | url | opensource org licenses mit | (?:https? )?(?:www )?opensource org licenses mit(?: license)?(?: (?:html|php))?
bsd-3-clause | url | opensource org licenses bsd | (?:https? )?(?:www )?opensource org licenses bsd 3 clause
bsd-2-clause | url | opensource org licenses bsd | (?:https? )?(?:www )?opensource org licenses bsd 2 clause
bsd | url | opensource org licenses bsd | (?:https? )?(?:www )?opensource org licenses bsd license(?: (?:html|php))?
gpl-2.0 | url | gnu org licenses | (?:https? )?(?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: (?:html|txt|en html))?
gpl-3.0 | url | gnu org licenses | (?:https? )?(?:www )?gnu org licenses gpl 3 0(?: (?:html|txt|en html))?
gpl | url | gnu org licenses | (?:https? )?(?:www )?gnu org licenses gpl(?: (?:html|txt))?
lgpl | url | gnu org licenses lgpl | (?:https? )?(?:www )?gnu org licenses lgpl(?: [23] \d)?(?: (?:html|txt))?
agpl-3.0 | url | gnu org licenses agpl | (?:https? )?(?:www )?gnu org licenses agpl(?: 3 0)?(?: (?:html|txt))?
gpl | url | gnu org licenses | (?:https? )?(?:www )?gnu org licenses
mpl-2.0 | url | mozilla org mpl | (?:https? )?(?:www )?mozilla org mpl 2 0
mpl | url | mozilla org mpl | (?:https? )?(?:www )?mozilla org mpl
epl-2.0 | url | eclipse org legal epl | (?:https? )?(?:www )?eclipse org legal epl 2 0(?: html)?
epl-1.0 | url | eclipse org legal epl | (?:https? )?(?:www )?eclipse org legal epl v10(?: html)?
bsl-1.0 | url | boost org license | (?:https? )?(?:www )?boost org license 1 0(?: txt)?
unlicense | url | unlicense org | (?:https? )?(?:www )?unlicense org
wtfpl | url | wtfpl net | (?:https? )?(?:www )?wtfpl net
cc-by-nc-nd | url | creativecommons org licenses | (?:https? )?(?:www )?creativecommons org licenses by nc nd(?: \d \d)?
cc-by-nc-sa | url | creativecommons org licenses | (?:https? )?(?:www )?creativecommons org licenses by nc sa(?: \d \d)?
cc-by-nc | url | creativecommons org licenses | (?:https? )?(?:www )?creativecommons org licenses by nc(?: \d \d)?
cc-by-nd | url | creativecommons org licenses | (?:https? )?(?:www )?creativecommons org licenses by nd(?: \d \d)?
cc-by-sa | url | creativecommons org licenses | (?:https? )?(?:www )?creativecommons org licenses by sa(?: \d \d)?
cc-by | url | creativecommons org licenses | (?:https? )?(?:www )?creativecommons org licenses by(?: \d \d)?
cc0-1.0 | url | creativecommons org publicdomain | (?:https? )?(?:www )?creativecommons org publicdomain zero(?: 1 0)?
public-domain | url | creativecommons org publicdomain | (?:https? )?(?:www )?creativecommons org publicdomain mark(?: 1 0)?
ofl-1.1 | url | scripts sil org ofl | (?:https? )?(?:www )?scripts sil org ofl
ogl-uk | url | nationalarchives gov uk | (?:https? )?(?:www )?nationalarchives gov uk doc open government licence
odbl | url | opendatacommons org | (?:https? )?(?:www )?opendatacommons org licenses odbl(?: 1 0)?
odc-by | url | opendatacommons org | (?:https? )?(?:www )?opendatacommons org licenses by(?: 1 0)?
pddl | url | opendatacommons org | (?:https? )?(?:www )?opendatacommons org licenses pddl(?: 1 0)?
artistic-2.0 | url | perlfoundation org | (?:https? )?(?:www )?perlfoundation org artistic license 2 0
spdx | url | spdx org licenses | (?:https? )?(?:www )?spdx org licenses(?: \S+){0,3}
apache-2.0 | name | apache license | apache license (?:version |v ?)?2(?: 0)?
apache-1.1 | name | apache software license | apache software license (?:version )?1 1
gpl-1.0 | name | general public license | gnu general public license (?:version |v ?)?1(?: 0)?
gpl-2.0 | name | general public license | gnu general public license (?:version |v ?)?2(?: 0)?
gpl-3.0 | name | general public license | gnu general public license (?:version |v ?)?3(?: 0)?
gpl-2.0 | name | gpl | (?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?
gpl-3.0 | name | gpl | (?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?
lgpl-2.0 | name | library general public license | gnu library general public license(?: (?:version |v ?)?2(?: 0)?)?
lgpl-2.1 | name | lesser general public license | gnu lesser general public license (?:version |v ?)?2 1
lgpl-3.0 | name | lesser general public license | gnu lesser general public license (?:version |v ?)?3(?: 0)?
lgpl-2.1 | name | lgpl | (?:gnu )?lgpl ?(?:version |v ?)?2 1
lgpl-3.0 | name | lgpl | (?:gnu )?lgpl ?(?:version |v ?)?3(?: 0)?
agpl-3.0 | name | affero general public license | gnu affero general public license (?:version |v ?)?3(?: 0)?
agpl-3.0 | name | agpl | (?:gnu )?agpl ?(?:version |v ?)?3(?: 0)?
mpl-1.1 | name | mozilla public license | mozilla public license (?:version |v ?)?1 1
mpl-2.0 | name | mozilla public license | mozilla public license (?:version |v ?)?2(?: 0)?
epl-1.0 | name | eclipse public license | eclipse public license (?:version |v ?)?1(?: 0)?
epl-2.0 | name | eclipse public license | eclipse public license (?:version |v ?)?2(?: 0)?
cddl-1.0 | name | common development and distribution license | common development and distribution license(?: cddl)? (?:version |v ?)?1(?: 0)?
bsd-2-clause | name | bsd license | (?:2 clause|simplified|two clause|freebsd) bsd license
bsd-3-clause | name | bsd license | (?:3 clause|new|modified|revised|three clause) bsd license
bsd-4-clause | name | bsd license | (?:4 clause|original|old) bsd license
cc-by-nc-nd | name | cc by nc nd | cc by nc nd(?: (?:1|2|3|4) \d)?
cc-by-nc-sa | name | cc by nc sa | cc by nc sa(?: (?:1|2|3|4) \d)?
cc-by-nc | name | cc by nc | cc by nc(?: (?:1|2|3|4) \d)?
cc-by-nd | name | cc by nd | cc by nd(?: (?:1|2|3|4) \d)?
cc-by-sa | name | cc by sa | cc by sa(?: (?:1|2|3|4) \d)?
cc-by | name | cc by | cc by (?:1|2|3|4) \d
cc-by-nc-nd | name | attribution | attribution non ?commercial no ?deriv(?:s|atives?)(?: (?:1|2|3|4) \d)?
cc-by-nc-sa | name | attribution | attribution non ?commercial share ?alike(?: (?:1|2|3|4) \d)?
cc-by-nc | name | attribution | attribution non ?commercial(?: (?:1|2|3|4) \d)?
cc-by-sa | name | attribution | attribution share ?alike(?: (?:1|2|3|4) \d)?
cc0-1.0 | name | cc0 | cc0 (?:1 0(?: universal)?|public domain dedication)
artistic-1.0 | name | artistic license | artistic license (?:version )?1(?: 0)?
artistic-2.0 | name | artistic license | artistic license (?:version )?2(?: 0)?
ofl-1.1 | name | open font license | (?:sil )?open font license(?: version)? 1 1
bsl-1.0 | name | boost software license | boost software license (?:version )?1 0
afl-3.0 | name | academic free license | academic free license (?:version |v ?)?3(?: 0)?
osl-3.0 | name | open software license | open software license (?:version |v ?)?3(?: 0)?
eupl | name | european union public licen | european union public licen[cs]e(?: (?:version |v ?)?1 [012])?
gfdl | name | free documentation license | (?:gnu )?free documentation license(?: version)? 1 [123]
python-2.0 | name | python software foundation license | python software foundation license(?: version 2)?
php-3.01 | name | php license | php license (?:version )?3 0 ?1
zpl-2.1 | name | zope public license | zope public license(?: (?:version )?2 [01])?
ms-pl | name | microsoft public license | microsoft public license(?: ms pl)?
ms-rl | name | microsoft reciprocal license | microsoft reciprocal license(?: ms rl)?
upl-1.0 | name | universal permissive license | universal permissive license(?: (?:version |v ?)?1 0)?
ncsa | name | illinois ncsa | university of illinois ncsa open source license
cecill | name | cecill | cecill(?: (?:b|c|2 [01]))?(?: licen[cs]e)?
ecl-2.0 | name | educational community license | educational community license(?: (?:version )?2 0)?
lppl | name | latex project public license | latex project public license(?: (?:version )?1 \d(?: ?[a-z])?)?
ogl-uk | name | open government licen | open government licen[cs]e (?:version |v ?)?[123](?: 0)?
apache | plain | apache | apache (?:software )?license
mit | plain | mit licen | mit licen[cs]e
x11 | plain | x11 license | (?:mit )?x11 license
bsd | plain | bsd | bsd (?:style )?licen[cs]e
isc | plain | isc license | isc license
zlib | plain | zlib | zlib(?: libpng)? licen[cs]e
gpl | plain | general public license | (?:gnu )?general public license
gpl | plain | gpl | gnu gpl
lgpl | plain | lesser general public license | (?:gnu )?lesser general public license
agpl | plain | affero general public license | (?:gnu )?affero general public license
mpl | plain | mozilla public license | mozilla public license
epl | plain | eclipse public license | eclipse public license
cddl | plain | common development and distribution license | common development and distribution license
artistic | plain | artistic license | artistic license
ofl | plain | open font license | (?:sil )?open font license
unlicense | plain | the unlicense | the unlicense
wtfpl | plain | wtfpl | wtfpl
creative-commons | plain | creative commons | creative commons(?: attribution)?(?: licen[cs]e)?
gfdl | plain | free documentation license | (?:gnu )?free documentation license
public-domain | plain | public domain | public domain(?: dedication)?
odbl | plain | open database license | open database license
ogl-uk | plain | open government licen | open government licen[cs]e
busl | plain | business source license | business source license
sspl | plain | server side public license | server side public license
copyright | hint | copyright | copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)?
copyright | hint | all rights reserved | all rights reserved
copyright | hint | the copyright | the copyright (?:holders?|owners?)
proprietary | hint | proprietary | proprietary and confidential
proprietary | hint | confidential | confidential and proprietary
license | hint | terms of use | subject to (?:the|our) terms of use
license | hint | license agreement | end user license agreement
license | hint | with permission | (?:used|reprinted|reproduced) with permission
"""
# ---------------------------------------------------------------------------------


def parse(text: str) -> list[tuple[str, str, str, str]]:
    """(label, kind, keyword, pattern) of each line, in the order of priority."""
    rows = [tuple(part.strip() for part in line.split(" | ", 3)) for line in text.strip().splitlines()]
    order = list(KINDS)
    gap = r"(?:\S+ ){0,6}?"
    return [(label, kind, keyword, pattern.replace("~ ", gap))
            for label, kind, keyword, pattern in sorted(rows, key=lambda r: order.index(r[1]))]
