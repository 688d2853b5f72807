"""The ordered signature rules of the license scan, written by hand.

A line: label | level | keyword | pattern. Patterns are over words (lower case, one space between two
words; ``[^ ]+`` is any word). The keyword is a word that every match of the pattern holds. Level 4 is a
machine-readable tag or a full notice, 3 a name with its version, 2 a name, 1 a hint. Of rules of one
level the earlier one goes first.
"""

RULES = """
apache-2.0 | 4 | spdx | spdx license identifier apache 2 0
mit | 4 | spdx | spdx license identifier mit
isc | 4 | spdx | spdx license identifier isc
bsd-2-clause | 4 | spdx | spdx license identifier bsd 2 clause
bsd-3-clause | 4 | spdx | spdx license identifier bsd 3 clause
0bsd | 4 | spdx | spdx license identifier 0bsd
gpl-2.0 | 4 | spdx | spdx license identifier gpl 2 0( only| or later)?
gpl-3.0 | 4 | spdx | spdx license identifier gpl 3 0( only| or later)?
lgpl-2.1 | 4 | spdx | spdx license identifier lgpl 2 1( only| or later)?
lgpl-3.0 | 4 | spdx | spdx license identifier lgpl 3 0( only| or later)?
agpl-3.0 | 4 | spdx | spdx license identifier agpl 3 0( only| or later)?
mpl-2.0 | 4 | spdx | spdx license identifier mpl 2 0
epl-2.0 | 4 | spdx | spdx license identifier epl 2 0
cc0-1.0 | 4 | spdx | spdx license identifier cc0 1 0
cc-by-4.0 | 4 | spdx | spdx license identifier cc by 4 0
cc-by-sa-4.0 | 4 | spdx | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | 4 | spdx | spdx license identifier cc by nc 4 0
unlicense | 4 | spdx | spdx license identifier unlicense
bsl-1.0 | 4 | spdx | spdx license identifier bsl 1 0
zlib | 4 | spdx | spdx license identifier zlib
artistic-2.0 | 4 | spdx | spdx license identifier artistic 2 0
ofl-1.1 | 4 | spdx | spdx license identifier ofl 1 1
spdx-other | 1 | spdx | spdx license identifier [^ ]+
apache-2.0 | 4 | apache | licensed under the apache license version 2 0( the license)?
apache-2.0 | 4 | apache | (released|distributed|available|published) under the( terms of the)? apache license version 2( 0)?
apache-1.1 | 4 | apache | (licensed|released|distributed) under the apache software license version 1 1
apache-2.0 | 3 | apache | apache( software)? licen[cs]e( version| v)? 2( 0)?
apache-2.0 | 3 | apache | apache 2 0( licen[cs]ed?)?
apache-1.1 | 3 | apache | apache( software)? licen[cs]e( version| v)? 1 1
apache-1.0 | 3 | apache | apache( software)? licen[cs]e( version| v)? 1 0
apache | 2 | apache | apache( software)? licen[cs]e
apache | 1 | apache | apache licensed
mit | 4 | granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 4 | noninfringement | including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | 4 | mit | (licensed|released|distributed|available|published) under( the)?( terms of)?( the)? mit licen[cs]e
mit | 3 | mit | mit x11 licen[cs]e
mit | 3 | mit | mit expat licen[cs]e
mit-0 | 3 | mit | mit no attribution( licen[cs]e)?
mit-0 | 3 | mit | mit 0 licen[cs]e
mit | 2 | mit | mit licen[cs]e
mit | 2 | mit | mit style licen[cs]e
mit | 1 | mit | mit licensed
mit | 2 | expat | expat licen[cs]e
x11 | 2 | x11 | x11 licen[cs]e
isc | 4 | isc | (licensed|released|distributed|available) under( the)?( terms of)?( the)? isc licen[cs]e
isc | 4 | copy | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 2 | isc | isc licen[cs]e
bsd-3-clause | 4 | endorse | neither the names? of( the)?( [^ ]+){1,8} may be used to endorse or promote products derived from this software
bsd-4-clause | 4 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause | 4 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | 4 | bsd | (licensed|released|distributed|available) under( the)?( terms of)?( the)? (simplified bsd|bsd 2 clause|2 clause bsd) licen[cs]e
bsd-3-clause | 4 | bsd | (licensed|released|distributed|available) under( the)?( terms of)?( the)? (new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd) licen[cs]e
bsd | 4 | bsd | (licensed|released|distributed|available) under( the)?( terms of)?( the| a)? bsd( style)? licen[cs]e
bsd-2-clause | 3 | bsd | (simplified bsd|freebsd bsd|bsd 2 clause|2 clause bsd|two clause bsd)( licen[cs]e)?
bsd-3-clause | 3 | bsd | (new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)( licen[cs]e)?
bsd-4-clause | 3 | bsd | (original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd)( licen[cs]e)?
0bsd | 3 | bsd | (zero clause bsd|bsd zero clause)( licen[cs]e)?
0bsd | 3 | 0bsd | 0bsd( licen[cs]e)?
bsd | 2 | bsd | bsd( style)? licen[cs]e
bsd | 1 | bsd | bsd licensed
gpl-3.0 | 4 | general | (licensed|released|distributed|available|published) under( the)?( terms of)?( the)? gnu general public licen[cs]e( version| v)? 3( 0)?
gpl-2.0 | 4 | general | (licensed|released|distributed|available|published) under( the)?( terms of)?( the)? gnu general public licen[cs]e( version| v)? 2( 0)?
gpl-2.0-or-later | 4 | general | gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version
gpl-3.0-or-later | 4 | general | gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
gpl-2.0 | 4 | general | gnu general public licen[cs]e version 2 as published by the free software foundation
gpl-3.0 | 4 | general | gnu general public licen[cs]e version 3 as published by the free software foundation
gpl-1.0 | 3 | general | general public licen[cs]e( gpl)?( version| v)? 1( 0)?
gpl-2.0 | 3 | general | general public licen[cs]e( gpl)?( version| v)? 2( 0)?
gpl-3.0 | 3 | general | general public licen[cs]e( gpl)?( version| v)? 3( 0)?
gpl-2.0 | 3 | general | general public licen[cs]e v2( 0)?
gpl-3.0 | 3 | general | general public licen[cs]e v3( 0)?
gpl | 2 | general | (gnu )?general public licen[cs]e
gpl-1.0 | 3 | gpl | gpl( version| v)? 1( 0)?
gpl-2.0 | 3 | gpl | (gnu )?gpl( version| v)? 2( 0)?
gpl-3.0 | 3 | gpl | (gnu )?gpl( version| v)? 3( 0)?
gpl | 2 | gpl | gnu gpl
gpl | 2 | gpl | gpl licen[cs]ed?
gpl | 1 | gpl | under the gpl
gpl-2.0 | 3 | gplv2 | gplv2( only| or later)?
gpl-3.0 | 3 | gplv3 | gplv3( only| or later)?
gpl-2.0 | 3 | gpl2 | gpl2
gpl-3.0 | 3 | gpl3 | gpl3
lgpl-2.1 | 4 | lesser | gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or at your option any later version
lgpl-3.0 | 4 | lesser | gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
lgpl-2.0 | 4 | library | gnu library general public licen[cs]e as published by the free software foundation
lgpl-2.1 | 3 | lesser | lesser general public licen[cs]e( lgpl)?( version| v)? 2 1
lgpl-3.0 | 3 | lesser | lesser general public licen[cs]e( lgpl)?( version| v)? 3( 0)?
lgpl | 2 | lesser | (gnu )?lesser general public licen[cs]e
lgpl-2.0 | 3 | library | library general public licen[cs]e( version| v)? 2( 0)?
lgpl-2.0 | 2 | library | (gnu )?library general public licen[cs]e
lgpl-2.1 | 3 | lgpl | (gnu )?lgpl( version| v)? 2 1
lgpl-3.0 | 3 | lgpl | (gnu )?lgpl( version| v)? 3( 0)?
lgpl | 2 | lgpl | gnu lgpl
lgpl | 2 | lgpl | lgpl licen[cs]ed?
lgpl | 1 | lgpl | under the lgpl
lgpl-2.1 | 3 | lgplv2 | lgplv2( 1)?
lgpl-3.0 | 3 | lgplv3 | lgplv3
agpl-3.0 | 4 | affero | gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
agpl-3.0 | 3 | affero | affero general public licen[cs]e( agpl)?( version| v)? 3( 0)?
agpl-1.0 | 3 | affero | affero general public licen[cs]e( version| v)? 1( 0)?
agpl | 2 | affero | (gnu )?affero general public licen[cs]e
agpl-3.0 | 3 | agpl | (gnu )?agpl( version| v)? 3( 0)?
agpl | 2 | agpl | gnu agpl
agpl | 2 | agpl | agpl licen[cs]ed?
agpl-3.0 | 3 | agplv3 | agplv3
gfdl-1.3 | 4 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e version 1 3
gfdl-1.2 | 4 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e version 1 2
gfdl-1.3 | 3 | documentation | free documentation licen[cs]e( version| v)? 1 3
gfdl-1.2 | 3 | documentation | free documentation licen[cs]e( version| v)? 1 2
gfdl-1.1 | 3 | documentation | free documentation licen[cs]e( version| v)? 1 1
gfdl | 2 | documentation | (gnu )?free documentation licen[cs]e
gfdl | 2 | gfdl | gfdl
gpl-classpath | 3 | classpath | gpl( v)?( 2)? with( the)? classpath exception
gpl-classpath | 2 | classpath | classpath exception
mpl-2.0 | 4 | mozilla | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-1.1 | 4 | mozilla | the contents of this file are subject to the mozilla public licen[cs]e version 1 1
mpl-2.0 | 3 | mozilla | mozilla public licen[cs]e( mpl)?( version| v)? 2( 0)?
mpl-1.1 | 3 | mozilla | mozilla public licen[cs]e( mpl)?( version| v)? 1 1
mpl-1.0 | 3 | mozilla | mozilla public licen[cs]e( mpl)?( version| v)? 1 0
mpl | 2 | mozilla | mozilla public licen[cs]e
mpl-2.0 | 3 | mpl | mpl( version| v)? 2( 0)?
mpl-1.1 | 3 | mpl | mpl( version| v)? 1 1
mpl | 2 | mpl | mpl licen[cs]ed?
epl-2.0 | 4 | eclipse | made available under the terms of the eclipse public licen[cs]e( version| v)? 2 0
epl-1.0 | 4 | eclipse | made available under the terms of the eclipse public licen[cs]e v1 0
epl-2.0 | 3 | eclipse | eclipse public licen[cs]e( version| v)? 2( 0)?
epl-1.0 | 3 | eclipse | eclipse public licen[cs]e( version| v)? 1( 0)?
epl | 2 | eclipse | eclipse public licen[cs]e
edl-1.0 | 2 | eclipse | eclipse distribution licen[cs]e
epl-2.0 | 3 | epl | epl( v)? 2 0
epl-1.0 | 3 | epl | epl( v)? 1 0
cpl-1.0 | 2 | common | common public licen[cs]e
cddl-1.1 | 3 | cddl | cddl( version| v)? 1 1
cddl-1.0 | 3 | cddl | cddl( version| v)? 1 0
cddl | 1 | cddl | cddl
cddl | 2 | distribution | common development and distribution licen[cs]e
eupl-1.2 | 3 | eupl | eupl( version| v)? 1 2
eupl-1.1 | 3 | eupl | eupl( version| v)? 1 1
eupl | 1 | eupl | eupl
eupl | 2 | european | european union public licen[cs]e
osl-3.0 | 2 | open | open software licen[cs]e( version| v)?( 3 0)?
afl-3.0 | 2 | academic | academic free licen[cs]e( version| v)?( 3 0)?
artistic-2.0 | 3 | artistic | artistic licen[cs]e( version| v)? 2( 0)?
artistic-1.0 | 3 | artistic | artistic licen[cs]e( version| v)? 1( 0)?
artistic | 2 | artistic | artistic licen[cs]e
perl | 4 | perl | same terms as perl( 5)?( itself)?
perl | 3 | perl | under the same terms as perl
bsl-1.0 | 4 | boost | distributed under the boost software licen[cs]e version 1 0
bsl-1.0 | 3 | boost | boost software licen[cs]e( version| v)? 1( 0)?
bsl-1.0 | 2 | boost | boost( software)? licen[cs]e
zlib | 4 | misrepresented | the origin of this software must not be misrepresented
zlib | 2 | zlib | zlib( libpng)? licen[cs]e
libpng | 2 | libpng | libpng licen[cs]e
openssl | 4 | openssl | this product includes software developed by the openssl project
openssl | 2 | openssl | openssl licen[cs]e
curl | 2 | curl | curl licen[cs]e
python-2.0 | 3 | python | python software foundation licen[cs]e( version| v)? 2
python-2.0 | 3 | psf | psf licen[cs]e( version| v)? 2
python | 2 | python | python( software foundation)? licen[cs]e
psf | 2 | psf | psf licen[cs]e
php-3.01 | 3 | php | php licen[cs]e( version| v)? 3 01
php | 2 | php | php licen[cs]e
ruby | 2 | ruby | ruby licen[cs]e
postgresql | 2 | postgresql | postgresql licen[cs]e
ncsa | 2 | ncsa | (university of illinois )?ncsa( open source)? licen[cs]e
w3c | 2 | w3c | w3c( software)?( notice and)? licen[cs]e
unicode | 2 | unicode | unicode( terms of use| licen[cs]e)
icu | 2 | icu | icu licen[cs]e
json | 4 | evil | the software shall be used for good not evil
vim | 2 | vim | vim licen[cs]e
beerware | 4 | beer | you can buy me a beer in return
beerware | 2 | beerware | beerware( licen[cs]e)?
wtfpl | 2 | wtfpl | wtfpl
wtfpl | 3 | want | do what the fuck you want to public licen[cs]e
unlicense | 4 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 2 | unlicense | (the )?unlicense
public-domain | 4 | domain | (released|dedicated|placed|placed in|released in|released into|dedicated to|placed into) the public domain
public-domain | 3 | domain | public domain dedication
public-domain | 2 | domain | in the public domain
public-domain | 1 | domain | public domain
cc0-1.0 | 4 | cc0 | (licensed|released|available|published) under( the)?( creative commons)? cc0( 1 0)?( universal)?
cc0-1.0 | 3 | cc0 | cc0 1 0( universal)?
cc0-1.0 | 2 | cc0 | cc0
cc0-1.0 | 3 | zero | creative commons zero( v1 0)?( universal)?
cc-by-nc-nd-4.0 | 4 | cc | (licensed|released|available|published) under( a| the)?( creative commons)? cc by nc nd 4 0
cc-by-nc-sa-4.0 | 4 | cc | (licensed|released|available|published) under( a| the)?( creative commons)? cc by nc sa 4 0
cc-by-nc-4.0 | 4 | cc | (licensed|released|available|published) under( a| the)?( creative commons)? cc by nc 4 0
cc-by-nd-4.0 | 4 | cc | (licensed|released|available|published) under( a| the)?( creative commons)? cc by nd 4 0
cc-by-sa-4.0 | 4 | cc | (licensed|released|available|published) under( a| the)?( creative commons)? cc by sa 4 0
cc-by-4.0 | 4 | cc | (licensed|released|available|published) under( a| the)?( creative commons)? cc by 4 0
cc-by-nc-nd-4.0 | 3 | cc | cc by nc nd 4 0
cc-by-nc-nd-3.0 | 3 | cc | cc by nc nd 3 0
cc-by-nc-nd | 2 | cc | cc by nc nd
cc-by-nc-sa-4.0 | 3 | cc | cc by nc sa 4 0
cc-by-nc-sa-3.0 | 3 | cc | cc by nc sa 3 0
cc-by-nc-sa | 2 | cc | cc by nc sa
cc-by-nc-4.0 | 3 | cc | cc by nc 4 0
cc-by-nc-3.0 | 3 | cc | cc by nc 3 0
cc-by-nc | 2 | cc | cc by nc
cc-by-nd-4.0 | 3 | cc | cc by nd 4 0
cc-by-nd-3.0 | 3 | cc | cc by nd 3 0
cc-by-nd | 2 | cc | cc by nd
cc-by-sa-4.0 | 3 | cc | cc by sa 4 0
cc-by-sa-3.0 | 3 | cc | cc by sa 3 0
cc-by-sa-2.5 | 3 | cc | cc by sa 2 5
cc-by-sa | 2 | cc | cc by sa
cc-by-4.0 | 3 | cc | cc by 4 0
cc-by-3.0 | 3 | cc | cc by 3 0
cc-by-2.5 | 3 | cc | cc by 2 5
cc-by | 2 | cc | cc by
cc-by-nc-nd | 3 | noderivs | attribution (noncommercial|non commercial) noderivs
cc-by-nc-nd | 3 | noderivatives | attribution (noncommercial|non commercial) noderivatives( 4 0)?( international)?
cc-by-nc-sa | 3 | sharealike | attribution noncommercial sharealike( 4 0| 3 0)?( international| unported)?
cc-by-nc | 3 | noncommercial | (creative commons )?attribution noncommercial( 4 0| 3 0)?( international| unported)?
cc-by-nd | 3 | noderivatives | (creative commons )?attribution noderivatives( 4 0| 3 0)?( international| unported)?
cc-by-sa | 3 | sharealike | (creative commons )?attribution sharealike( 4 0| 3 0)?( international| unported)?
cc-by | 3 | attribution | creative commons attribution( 4 0| 3 0)?( international| unported)?( licen[cs]e)?
creative-commons | 1 | commons | creative commons( licen[cs]e)?
cc-url | 3 | creativecommons | creativecommons org licenses by( nc)?( sa| nd)?( 4 0| 3 0| 2 5| 2 0)?
cc0-1.0 | 3 | creativecommons | creativecommons org publicdomain zero 1 0
odbl-1.0 | 3 | database | open (data commons open )?database licen[cs]e( odbl)?
odbl-1.0 | 2 | odbl | odbl( v)?( 1 0)?
odc-by-1.0 | 3 | odc | odc by( 1 0)?
pddl-1.0 | 2 | pddl | (odc )?pddl( 1 0)?
cdla-permissive | 2 | cdla | cdla permissive( 1 0| 2 0)?
cdla-sharing | 2 | cdla | cdla sharing( 1 0)?
ogl-3.0 | 3 | government | open government licen[cs]e( version| v)?( 3 0)?
etalab-2.0 | 2 | etalab | etalab( 2 0)?
ofl-1.1 | 4 | sil | licensed under the sil open font licen[cs]e version 1 1
ofl-1.1 | 3 | font | (sil )?open font licen[cs]e( version| v)?( 1 1)?
ofl-1.1 | 2 | ofl | ofl( 1 1)?
cecill-2.1 | 2 | cecill | cecill( [bc])?( 2 1)?
mspl | 2 | permissive | microsoft permissive licen[cs]e
mspl | 2 | microsoft | microsoft public licen[cs]e( ms pl)?
msrl | 2 | reciprocal | microsoft reciprocal licen[cs]e
elastic-2.0 | 3 | elastic | elastic licen[cs]e( version| v)?( 2 0)?
sspl-1.0 | 3 | side | server side public licen[cs]e( version| v)?( 1)?
busl-1.1 | 3 | business | business source licen[cs]e( version| v)?( 1 1)?
commons-clause | 3 | clause | commons clause( licen[cs]e)?( condition)?
polyform | 2 | polyform | polyform (noncommercial|small business|shield|strict|internal use)( licen[cs]e)?
openrail | 2 | openrail | (creativeml |bigscience )?openrail( m)?
reserved | 4 | reserved | copyright( c)?( [^ ]+){1,8} all rights reserved
reserved | 2 | reserved | all rights reserved
reserved-some | 2 | reserved | some rights reserved
reserved | 3 | droits | tous droits réservés
reserved | 3 | rechte | alle rechte vorbehalten
reserved | 3 | derechos | todos los derechos reservados
reserved | 3 | diritti | tutti i diritti riservati
proprietary | 4 | proprietary | (this|the) software is( the)?( confidential and)? proprietary( information)?
proprietary | 3 | proprietary | proprietary and confidential
proprietary | 3 | confidential | confidential and proprietary
proprietary | 2 | prohibited | unauthori[sz]ed (copying|reproduction|distribution)( [^ ]+){0,6} (is strictly|strictly) prohibited
proprietary | 2 | agreement | end user licen[cs]e agreement( eula)?
no-commercial-use | 2 | commercial | (for )?non commercial use only
no-commercial-use | 2 | noncommercial | noncommercial use only
personal-use | 2 | personal | for personal( and non commercial)? use only
evaluation-only | 2 | evaluation | for evaluation( purposes)? only
no-redistribution | 2 | redistribute | (do not|may not|must not) redistribute
no-redistribution | 2 | reproduced | no part of this( [^ ]+){1,4} may be reproduced
no-training | 2 | training | (may|must) not be used( for| in)?( [^ ]+){0,4} training
permission-required | 2 | permission | without( the)?( prior)?( express)? written permission
copyright-notice | 1 | copyright | copyright( c)? (19|20)[0-9][0-9]
dual-license | 2 | dual | dual licensed
license-file | 1 | license | see( the)? license( file)? for( more)? details
"""
