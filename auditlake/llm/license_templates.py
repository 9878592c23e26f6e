"""Wording by which licence families are known, and wording of no certain family."""

#: Family and wording.  Notices first, then opening sentences of the texts themselves.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Licensed under the MIT license. See the LICENSE file in the project root for details."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Distributed under the Apache 2.0 license."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU GPL version 3 or later."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    ("LGPL", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("CC0", "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal dedication."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved."),
    ("proprietary", "Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited."),
]

#: Licence-like wording that names no family.
UNKNOWN: list[str] = [
    "See the license file for the terms of use.",
    "Distributed under a custom license agreement.",
    "Licensed under the terms found in the accompanying license document.",
    "Released under the license of the original project.",
    "This work is licensed under terms that are set out elsewhere.",
    "The license of this text is stated in the archive.",
    "Copyright of the contributors; license terms apply.",
    "Use is subject to the license granted by the publisher.",
    "Redistribution is subject to the agreement between the parties.",
    "Please read the license agreement before use.",
]

#: Ordinary text with the words of licences.
ORDINARY: list[str] = [
    "He got his driving license at the age of nineteen and never had an accident.",
    "The city council will license three more taxis for the summer season.",
    "She asked for permission to leave the table before the others had finished.",
    "Without written permission from the school no pupil may stay out late.",
    "The museum was granted permission to copy the painting for its new hall.",
    "A fishing license costs twelve dollars and is valid for one year.",
    "The singer lost a long fight over the copyright of her first songs.",
    "Copyright law was the subject of his lecture at the university in spring.",
    "The new plan is a redistribution of income from the cities to the villages.",
    "Food was redistributed among the families after the flood.",
    "The nurse renewed her license and moved to a hospital on the coast.",
    "Poetic license allows a writer to leave out what did not matter.",
    "The public may visit the gardens free of charge on the first Sunday of May.",
    "The pilot lost his licence after he flew too low over the town.",
    "The software was sold to a bank that never used it.",
    "The source of the river lies in the mountains to the north.",
    "A general from the public radio spoke about the version of events that he remembered.",
    "Restaurants with a license to sell wine have to close at midnight.",
]
