"""Signatures of licences, written for texts that are normalised to lower-case words with single blanks.

A line is `label ~ keyword ~ regex`. The keyword must occur before the regex is tried. Sections stand in order of
priority, and within a section earlier lines come first.
"""

#: Declarations by identifier: after "spdx license identifier", "license" or "licence" fields and the like.
TAGS = r"""
mit ~ spdx ~ spdx license identifier mit
mit-0 ~ spdx ~ spdx license identifier mit 0
apache-2 ~ spdx ~ spdx license identifier apache 2 0
apache-1.1 ~ spdx ~ spdx license identifier apache 1 1
bsd-2-clause ~ spdx ~ spdx license identifier bsd 2 clause
bsd-3-clause ~ spdx ~ spdx license identifier bsd 3 clause
bsd-4-clause ~ spdx ~ spdx license identifier bsd 4 clause
0bsd ~ spdx ~ spdx license identifier 0bsd
isc ~ spdx ~ spdx license identifier isc
zlib ~ spdx ~ spdx license identifier zlib
gpl-1 ~ spdx ~ spdx license identifier gpl 1 0(?: only| or later)?
gpl-2 ~ spdx ~ spdx license identifier gpl 2 0(?: only| or later)?
gpl-3 ~ spdx ~ spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2 ~ spdx ~ spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 ~ spdx ~ spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3 ~ spdx ~ spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3 ~ spdx ~ spdx license identifier agpl 3 0(?: only| or later)?
gfdl-1.3 ~ spdx ~ spdx license identifier gfdl 1 3(?: only| or later)?
mpl-1.1 ~ spdx ~ spdx license identifier mpl 1 1
mpl-2 ~ spdx ~ spdx license identifier mpl 2 0
epl-1 ~ spdx ~ spdx license identifier epl 1 0
epl-2 ~ spdx ~ spdx license identifier epl 2 0
cddl-1 ~ spdx ~ spdx license identifier cddl 1 [01]
eupl-1.2 ~ spdx ~ spdx license identifier eupl 1 2
unlicense ~ spdx ~ spdx license identifier unlicense
wtfpl ~ spdx ~ spdx license identifier wtfpl
bsl-1.0 ~ spdx ~ spdx license identifier bsl 1 0
busl-1.1 ~ spdx ~ spdx license identifier busl 1 1
sspl-1 ~ spdx ~ spdx license identifier sspl 1 0
cc0-1 ~ spdx ~ spdx license identifier cc0 1 0
cc-by ~ spdx ~ spdx license identifier cc by [1-4] [05]
cc-by-sa ~ spdx ~ spdx license identifier cc by sa [1-4] [05]
cc-by-nc ~ spdx ~ spdx license identifier cc by nc [1-4] [05]
cc-by-nc-sa ~ spdx ~ spdx license identifier cc by nc sa [1-4] [05]
cc-by-nd ~ spdx ~ spdx license identifier cc by nd [1-4] [05]
cc-by-nc-nd ~ spdx ~ spdx license identifier cc by nc nd [1-4] [05]
ofl-1.1 ~ spdx ~ spdx license identifier ofl 1 1
artistic-2 ~ spdx ~ spdx license identifier artistic 2 0
python-2 ~ spdx ~ spdx license identifier (?:python|psf) 2 0
postgresql ~ spdx ~ spdx license identifier postgresql
ncsa ~ spdx ~ spdx license identifier ncsa
ms-pl ~ spdx ~ spdx license identifier ms pl
x11 ~ spdx ~ spdx license identifier x11
afl-3 ~ spdx ~ spdx license identifier afl 3 0
osl-3 ~ spdx ~ spdx license identifier osl 3 0
upl-1 ~ spdx ~ spdx license identifier upl 1 0
blueoak-1 ~ spdx ~ spdx license identifier blueoak 1 0 0
odbl-1 ~ spdx ~ spdx license identifier odbl 1 0
mulan-2 ~ spdx ~ spdx license identifier mulanpsl 2 0
vim ~ spdx ~ spdx license identifier vim
mit ~ license mit ~ license mit
apache-2 ~ license apache ~ license apache 2(?: 0)?
bsd-3-clause ~ license bsd ~ license bsd 3 clause
bsd-2-clause ~ license bsd ~ license bsd 2 clause
gpl-3 ~ license gpl ~ license gpl ?v?3(?: 0)?
gpl-2 ~ license gpl ~ license gpl ?v?2(?: 0)?
lgpl-3 ~ license lgpl ~ license lgpl ?v?3(?: 0)?
lgpl-2.1 ~ license lgpl ~ license lgpl ?v?2 1
agpl-3 ~ license agpl ~ license agpl ?v?3(?: 0)?
mpl-2 ~ license mpl ~ license mpl ?v?2(?: 0)?
"""

#: Sentences of the licence texts and of their notices.
TEXTS = r"""
mit ~ permission is hereby granted ~ permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit ~ the above copyright notice and this permission ~ the above copyright notice and this permission notice shall be included in all copies
isc ~ permission to use copy modify and ~ permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc ~ permission to use copy modify and ~ permission to use copy modify and distribute this software for any purpose with or without fee
apache-2 ~ licensed under the apache ~ (?:is |are )?licensed under (?:the )?apache license(?: version)?(?: v)? ?2(?: 0)?
apache-2 ~ you may not use this file except ~ you may not use this file except in compliance with the license
apache-2 ~ www apache org ~ www apache org licenses license 2 0
apache-1.1 ~ apache software license ~ apache software license version 1 1
bsd-2-clause ~ redistribution and use in source ~ redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause ~ neither the name ~ neither the names? of .{1,80}? may be used to endorse or promote products derived
bsd-4-clause ~ all advertising materials ~ all advertising materials mentioning features or use of this software must display
gpl-3 ~ general public license ~ (?:is |are )?licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license(?: version| v)? ?3(?: 0)?(?: or (?:any )?later(?: version)?)?
gpl-2 ~ general public license ~ (?:is |are )?licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license(?: version| v)? ?2(?: 0)?(?: or (?:any )?later(?: version)?)?
gpl ~ general public license ~ under the terms of the gnu general public license(?: as published by the free software foundation)?
gpl-3 ~ as published by the free software ~ general public license as published by the free software foundation (?:either )?version 3
gpl-2 ~ as published by the free software ~ general public license as published by the free software foundation (?:either )?version 2
lgpl ~ lesser general public license ~ under the terms of the gnu lesser general public license
lgpl-2.1 ~ lesser general public license ~ lesser general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?2 1
lgpl-3 ~ lesser general public license ~ lesser general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?3(?: 0)?
lgpl-2 ~ library general public license ~ gnu library general public license(?: version| v)?(?: ?2)?(?: 0)?
agpl-3 ~ affero general public license ~ affero general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?3(?: 0)?
gpl ~ you should have received a copy ~ you should have received a copy of the gnu general public license
gfdl ~ free documentation license ~ permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2 ~ mozilla public ~ this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0
mpl-1.1 ~ mozilla public ~ subject to the mozilla public license version 1 1
epl-2 ~ eclipse public license ~ terms of the eclipse public license(?: v| version)? ?2 0
epl-1 ~ eclipse public license ~ terms of the eclipse public license(?: v| version)? ?1 0
zlib ~ provided as is without any express ~ this software is provided as is without any express or implied warranty in no event will the authors be held liable
unlicense ~ this is free and unencumbered ~ this is free and unencumbered software released into the public domain
wtfpl ~ what the fuck you want ~ do what the fuck you want to(?: public license)?
bsl-1.0 ~ boost software license ~ (?:distributed )?under the boost software license(?: version)? ?1 0
cddl-1 ~ common development ~ subject to the terms of the common development and distribution license
public-domain ~ public domain ~ (?:released|dedicated|placed) (?:in|in to|into|to) the public domain
public-domain ~ public domain ~ (?:this|the) (?:work|text|document|software) is in the public domain
cc0-1 ~ has waived all copyright ~ has waived all copyright and related or neighbou?ring rights
cc0-1 ~ creativecommons org ~ creativecommons org publicdomain zero 1 0
cc-by ~ creativecommons org ~ creativecommons org licenses by [1-4] [05]
cc-by-sa ~ creativecommons org ~ creativecommons org licenses by sa [1-4] [05]
cc-by-nc ~ creativecommons org ~ creativecommons org licenses by nc [1-4] [05]
cc-by-nd ~ creativecommons org ~ creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa ~ creativecommons org ~ creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd ~ creativecommons org ~ creativecommons org licenses by nc nd [1-4] [05]
proprietary ~ all rights reserved ~ all rights reserved
proprietary ~ confidential and proprietary ~ confidential and proprietary(?: information)?
proprietary ~ unauthorized copying ~ unauthorized copying of this (?:file|document|work)(?: via any medium)? is strictly prohibited
proprietary ~ without the prior written permission ~ may not be (?:reproduced|copied|distributed)[a-z ]{0,60}? without the prior written permission
proprietary ~ no part of this ~ no part of this (?:publication|book|work|document) may be reproduced
openrail ~ use based restrictions ~ use based restrictions as referenced in paragraph 5
llama ~ llama ~ llama [2-4](?: [0-9])? (?:community )?license(?: agreement)?
gpl-exception ~ classpath exception ~ (?:with the )?classpath exception
gpl-exception ~ special exception ~ as a special exception the copyright holders? of this library give you permission to link
sspl-1 ~ server side public license ~ server side public license(?: v| version)? ?1?
busl-1.1 ~ business source license ~ business source license(?: v| version)? ?1 1
elastic-2 ~ elastic license ~ elastic license(?: v| version)? ?2(?: 0)?
commons-clause ~ commons clause ~ commons clause(?: license)? condition(?: v| version)? ?1 0
"""

#: Names of licences as prose has them.
NAMES = r"""
mit ~ mit license ~ (?:the )?(?:terms of the )?mit(?: x11)? licen[cs]e
mit ~ expat license ~ (?:the )?expat licen[cs]e
mit-0 ~ mit no attribution ~ mit no attribution(?: license)?
x11 ~ x11 license ~ (?:the )?x11 licen[cs]e
apache-2 ~ apache ~ apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?(?: licen[cs]e)?
apache-1.1 ~ apache ~ apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?1 1
apache-1 ~ apache ~ apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?1 0
apache ~ apache license ~ (?:the )?apache(?: software)? license
bsd-2-clause ~ bsd ~ (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?
bsd-3-clause ~ bsd ~ (?:bsd 3 clause|3 clause bsd|three clause bsd|modified bsd|new bsd|revised bsd)(?: licen[cs]e)?
bsd-4-clause ~ bsd ~ (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: licen[cs]e)?
0bsd ~ bsd ~ (?:bsd zero clause|zero clause bsd|0bsd)(?: licen[cs]e)?
bsd ~ bsd license ~ (?:the )?bsd licen[cs]e
isc ~ isc license ~ (?:the )?isc licen[cs]e
zlib ~ zlib ~ (?:the )?zlib(?: libpng)? licen[cs]e
libpng ~ libpng license ~ (?:the )?libpng licen[cs]e
gpl-3 ~ gpl ~ (?:gnu )?gpl ?(?:version |v)?3(?: 0)?(?: or later)?
gpl-2 ~ gpl ~ (?:gnu )?gpl ?(?:version |v)?2(?: 0)?(?: or later)?
gpl-1 ~ gpl ~ (?:gnu )?gpl ?(?:version |v)?1(?: 0)?(?: or later)?
gpl-3 ~ general public license ~ (?:gnu )?general public license(?: version| v)? ?3(?: 0)?
gpl-2 ~ general public license ~ (?:gnu )?general public license(?: version| v)? ?2(?: 0)?
gpl-1 ~ general public license ~ (?:gnu )?general public license(?: version| v)? ?1(?: 0)?
gpl ~ general public license ~ (?:the )?gnu general public license
gpl ~ gpl ~ (?:the )?(?:gnu )?gpl licen[cs]e
lgpl-3 ~ lgpl ~ (?:gnu )?lgpl ?(?:version |v)?3(?: 0)?(?: or later)?
lgpl-2.1 ~ lgpl ~ (?:gnu )?lgpl ?(?:version |v)?2 1(?: or later)?
lgpl-2 ~ lgpl ~ (?:gnu )?lgpl ?(?:version |v)?2(?: 0)?(?: or later)?
lgpl ~ lesser general public license ~ (?:gnu )?lesser general public license
agpl-3 ~ agpl ~ (?:gnu )?agpl ?(?:version |v)?3(?: 0)?(?: or later)?
agpl-3 ~ affero general public license ~ (?:gnu )?affero general public license(?: version| v)? ?3(?: 0)?
agpl ~ affero general public license ~ (?:gnu )?affero general public license
gfdl ~ free documentation license ~ (?:gnu )?free documentation license(?: version| v)?(?: ?1 [1-3])?
mpl-2 ~ mozilla public ~ mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?
mpl-1.1 ~ mozilla public ~ mozilla public licen[cs]e(?: version| v)? ?1 1
mpl-1 ~ mozilla public ~ mozilla public licen[cs]e(?: version| v)? ?1 0
mpl ~ mozilla public ~ mozilla public licen[cs]e
epl-2 ~ eclipse public ~ eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?
epl-1 ~ eclipse public ~ eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?
edl-1 ~ eclipse distribution ~ eclipse distribution licen[cs]e(?: version| v)?(?: ?1 0)?
cddl-1 ~ cddl ~ cddl(?: version| v)? ?1 [01]
cddl-1 ~ common development and distribution ~ common development and distribution licen[cs]e(?: version| v)?(?: ?1 [01])?
cpl-1 ~ common public license ~ common public licen[cs]e(?: version| v)?(?: ?1 0)?
ipl-1 ~ ibm public license ~ ibm public licen[cs]e(?: version| v)?(?: ?1 0)?
eupl-1.2 ~ european union public ~ european union public licen[cs]e(?: version| v)? ?1 2
eupl-1.1 ~ european union public ~ european union public licen[cs]e(?: version| v)? ?1 1
eupl ~ european union public ~ european union public licen[cs]e
cecill-2 ~ cecill ~ cecill(?: licen[cs]e)?(?: version| v)? ?2(?: [01])?
cecill-b ~ cecill ~ cecill b(?: licen[cs]e)?
cecill-c ~ cecill ~ cecill c(?: licen[cs]e)?
artistic-2 ~ artistic license ~ artistic licen[cs]e(?: version| v)? ?2(?: 0)?
artistic-1 ~ artistic license ~ artistic licen[cs]e(?: version| v)? ?1(?: 0)?
artistic ~ artistic license ~ (?:the )?artistic licen[cs]e
bsl-1.0 ~ boost software ~ boost software licen[cs]e
unlicense ~ unlicense ~ (?:the )?unlicense
wtfpl ~ wtfpl ~ (?:the )?wtfpl
beerware ~ beer ~ beer ?ware licen[cs]e
postgresql ~ postgresql license ~ (?:the )?postgresql licen[cs]e
python-2 ~ python ~ python(?: software foundation)? licen[cs]e(?: version| v)?(?: ?2(?: 0)?)?
ruby ~ ruby license ~ (?:the )?ruby licen[cs]e
php-3.01 ~ php license ~ (?:the )?php licen[cs]e(?: version| v)?(?: ?3 0?1)?
perl ~ same terms as perl ~ same terms as perl(?: itself)?
tcl ~ tcl ~ tcl(?: tk)? licen[cs]e
vim ~ vim license ~ (?:the )?vim licen[cs]e
openssl ~ openssl license ~ (?:the )?openssl licen[cs]e
ssleay ~ ssleay license ~ (?:the )?(?:original )?ssleay licen[cs]e
curl ~ curl license ~ (?:the )?curl licen[cs]e
ncsa ~ illinois ~ (?:university of illinois|illinois)(?: ncsa)? open source licen[cs]e
ms-pl ~ microsoft public ~ microsoft public licen[cs]e
ms-rl ~ microsoft reciprocal ~ microsoft reciprocal licen[cs]e
afl-3 ~ academic free license ~ academic free licen[cs]e(?: version| v)?(?: ?3 0)?
osl-3 ~ open software license ~ open software licen[cs]e(?: version| v)?(?: ?3 0)?
upl-1 ~ universal permissive ~ universal permissive licen[cs]e(?: version| v)?(?: ?1 0)?
ecl-2 ~ educational community ~ educational community licen[cs]e(?: version| v)?(?: ?2 0)?
blueoak-1 ~ blue oak model ~ blue oak model licen[cs]e(?: version| v)?(?: ?1 0 0)?
mulan-2 ~ mulan ~ mulan(?: permissive software)? licen[cs]e(?: version| v)?(?: ?2)?
cpal-1 ~ common public attribution ~ common public attribution licen[cs]e(?: version| v)?(?: ?1 0)?
apsl-2 ~ apple public source ~ apple public source licen[cs]e(?: version| v)?(?: ?2 0)?
npl-1.1 ~ netscape public ~ netscape public licen[cs]e(?: version| v)?(?: ?1 [01])?
qpl-1 ~ q public license ~ q public licen[cs]e(?: version| v)?(?: ?1 0)?
sleepycat ~ sleepycat license ~ (?:the )?sleepycat licen[cs]e
w3c ~ w3c ~ w3c(?: software)?(?: notice and)? licen[cs]e
unicode ~ unicode ~ unicode(?: inc)? licen[cs]e(?: agreement)?
ofl-1.1 ~ open font license ~ (?:sil )?open font licen[cs]e(?: version| v)?(?: ?1 1)?
ubuntu-font ~ ubuntu font ~ ubuntu font licen[cs]e(?: version| v)?(?: ?1 0)?
lppl-1.3c ~ latex project public ~ latex project public licen[cs]e(?: version| v)?(?: ?1 3c?)?
json ~ good not evil ~ shall be used for good not evil
naist ~ naist license ~ naist licen[cs]e
hpnd ~ historical permission notice ~ historical permission notice and disclaimer
zpl-2.1 ~ zope public license ~ zope public licen[cs]e(?: version| v)?(?: ?2 [01])?
ogl-uk-3 ~ open government licen ~ open government licen[cs]e(?: version| v)?(?: ?3 0)?
etalab-2 ~ licence ouverte ~ licence ouverte(?: open licence)?(?: version| v)?(?: ?2 0)?
dl-de-by-2 ~ datenlizenz deutschland ~ datenlizenz deutschland(?: namensnennung| zero)?(?: version)?(?: ?2 0)?
odbl-1 ~ open database license ~ open database licen[cs]e(?: version| v)?(?: ?1 0)?
odc-by-1 ~ open data commons attribution ~ open data commons attribution licen[cs]e(?: version| v)?(?: ?1 0)?
pddl-1 ~ public domain dedication and license ~ public domain dedication and licen[cs]e(?: version| v)?(?: ?1 0)?
cdla-permissive-2 ~ community data license ~ community data licen[cs]e agreement permissive(?: version| v)?(?: ?2 0)?
cdla-sharing-1 ~ community data license ~ community data licen[cs]e agreement sharing(?: version| v)?(?: ?1 0)?
cc0-1 ~ cc0 ~ (?:cc0|creative commons zero)(?: 1 0)?(?: universal)?
cc-by-nc-nd ~ cc by nc nd ~ cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa ~ cc by nc sa ~ cc by nc sa(?: [1-4] [05])?
cc-by-nc ~ cc by nc ~ cc by nc(?: [1-4] [05])?
cc-by-nd ~ cc by nd ~ cc by nd(?: [1-4] [05])?
cc-by-sa ~ cc by sa ~ cc by sa(?: [1-4] [05])?
cc-by ~ cc by ~ cc by [1-4] [05]
cc-by-nc-nd ~ creative commons attribution ~ creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?
cc-by-nc-sa ~ creative commons attribution ~ creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc ~ creative commons attribution ~ creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nd ~ creative commons attribution ~ creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?
cc-by-sa ~ creative commons attribution ~ creative commons attribution share ?alike(?: [1-4] [05])?
cc-by ~ creative commons attribution ~ creative commons attribution(?: [1-4] [05])?(?: international)?
creative-commons ~ creative commons licen ~ (?:a )?creative commons licen[cs]e
openrail ~ openrail ~ (?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[cs]e)?
gemma ~ gemma terms of use ~ gemma terms of use
polyform ~ polyform ~ polyform (?:noncommercial|small business|shield|strict|free trial)(?: licen[cs]e)?
parity-7 ~ parity public license ~ parity public licen[cs]e(?: 7 0 0)?
prosperity-3 ~ prosperity public license ~ prosperity public licen[cs]e(?: 3 0 0)?
watcom-1 ~ sybase open watcom ~ sybase open watcom public licen[cs]e
intel ~ intel open source ~ intel open source licen[cs]e
nasa-1.3 ~ nasa open source ~ nasa open source agreement(?: 1 3)?
rpl-1.5 ~ reciprocal public license ~ reciprocal public licen[cs]e(?: 1 5)?
sissl ~ sun industry standards ~ sun industry standards source licen[cs]e
spl-1 ~ sun public license ~ sun public licen[cs]e(?: version| v)?(?: ?1 0)?
entessa ~ entessa public ~ entessa public licen[cs]e
frameworx-1 ~ frameworx ~ frameworx open licen[cs]e
motosoto ~ motosoto ~ motosoto open source licen[cs]e
nokia ~ nokia open source ~ nokia open source licen[cs]e
oclc-2 ~ oclc research ~ oclc research public licen[cs]e
ricoh ~ ricoh source code ~ ricoh source code public licen[cs]e
vovida-1 ~ vovida ~ vovida software licen[cs]e
xnet ~ x net license ~ x net licen[cs]e
ipa ~ ipa font license ~ ipa font licen[cs]e
liliq-p ~ licence libre du qu ~ licence libre du québec(?: permissive)?
public-domain ~ domaine public ~ (?:dans le|au) domaine public
public-domain ~ dominio público ~ (?:en el|de) dominio público
public-domain ~ gemeinfrei ~ gemeinfrei(?:es|er|e)?
proprietary ~ tous droits réservés ~ tous droits réservés
proprietary ~ todos los derechos reservados ~ todos los derechos reservados
proprietary ~ alle rechte vorbehalten ~ alle rechte vorbehalten
shareware ~ shareware ~ shareware licen[cs]e(?: agreement)?
freeware ~ freeware ~ freeware licen[cs]e(?: agreement)?
eula ~ end user license agreement ~ end user licen[cs]e agreement
unknown-open ~ open source license ~ (?:an |any )?open source licen[cs]e
unknown ~ licensed under ~ licensed under (?:the )?[^ ]+ licen[cs]e
"""
