"""Fixed vocabularies: values that results depend on, stated plainly.

Every operator takes its vocabulary as an argument; these are the defaults. Lists and keys stand in
search order.
"""

from __future__ import annotations

# Fixed values below.

# ---- places and cities ----

# continents, large countries, empires, oceans, landmarks: never one map pin
COARSE_PLACES = [
    "world", "earth", "global", "international", "africa", "europe", "asia", "north america",
    "south america", "latin america", "middle east", "southeast asia", "central asia", "east asia",
    "west asia", "oceania", "arctic", "antarctica", "united states", "usa", "us", "u.s.", "united kingdom",
    "uk", "great britain", "britain", "england", "scotland", "wales", "ireland", "france", "germany",
    "india", "china", "japan", "russia", "canada", "australia", "spain", "italy", "turkey", "greece",
    "egypt", "mexico", "brazil", "argentina", "pakistan", "bangladesh", "nepal", "sri lanka", "afghanistan",
    "roman empire", "ottoman empire", "byzantine empire", "russian empire", "british empire",
    "atlantic ocean", "pacific ocean", "indian ocean", "mediterranean", "colosseum", "eiffel tower",
]

# states of the USA
US_STATES = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware",
    "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky",
    "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri",
    "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york state",
    "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island",
    "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington",
    "west virginia", "wisconsin", "wyoming", "district of columbia",
]

# counties of the United Kingdom
UK_COUNTIES = [
    "yorkshire", "greater london", "greater manchester", "west midlands", "merseyside", "kent", "essex",
    "surrey", "hampshire", "sussex", "norfolk", "suffolk", "devon", "cornwall", "dorset", "somerset",
    "gloucestershire", "oxfordshire", "buckinghamshire", "berkshire", "hertfordshire", "cambridgeshire",
    "bedfordshire", "leicestershire", "northamptonshire", "warwickshire", "worcestershire", "herefordshire",
    "shropshire", "staffordshire", "derbyshire", "nottinghamshire", "lincolnshire", "lancashire", "cheshire",
    "cumbria", "northumberland", "durham", "tyne and wear", "west yorkshire", "south yorkshire",
    "east riding of yorkshire", "isle of wight", "isle of man", "anglesey", "powys", "gwynedd", "dyfed",
    "clwyd", "gwent", "mid glamorgan", "south glamorgan", "west glamorgan", "aberdeenshire", "argyll",
    "fife", "perthshire", "lanarkshire", "ayrshire",
]

# states and union territories of India
INDIAN_STATES = [
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana",
    "himachal pradesh", "jharkhand", "karnataka", "kerala", "madhya pradesh", "maharashtra", "manipur",
    "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan", "sikkim", "tamil nadu", "telangana",
    "tripura", "uttar pradesh", "uttarakhand", "west bengal", "andaman and nicobar islands", "chandigarh",
    "dadra and nagar haveli", "daman and diu", "lakshadweep", "puducherry", "jammu and kashmir", "ladakh",
]

# countries
COUNTRIES = [
    "afghanistan", "albania", "algeria", "andorra", "angola", "antigua and barbuda", "argentina", "armenia",
    "australia", "austria", "azerbaijan", "bahamas", "bahrain", "bangladesh", "barbados", "belarus",
    "belgium", "belize", "benin", "bhutan", "bolivia", "bosnia and herzegovina", "botswana", "brazil",
    "brunei", "bulgaria", "burkina faso", "burundi", "cambodia", "cameroon", "canada", "cape verde",
    "central african republic", "chad", "chile", "china", "colombia", "comoros", "congo", "costa rica",
    "croatia", "cuba", "cyprus", "czech republic", "denmark", "djibouti", "dominica", "dominican republic",
    "ecuador", "egypt", "el salvador", "equatorial guinea", "eritrea", "estonia", "eswatini", "ethiopia",
    "fiji", "finland", "france", "gabon", "gambia", "georgia", "germany", "ghana", "greece", "grenada",
    "guatemala", "guinea", "guinea-bissau", "guyana", "haiti", "honduras", "hungary", "iceland", "india",
    "indonesia", "iran", "iraq", "ireland", "israel", "italy", "ivory coast", "jamaica", "japan", "jordan",
    "kazakhstan", "kenya", "kiribati", "kuwait", "kyrgyzstan", "laos", "latvia", "lebanon", "lesotho",
    "liberia", "libya", "liechtenstein", "lithuania", "luxembourg", "madagascar", "malawi", "malaysia",
    "maldives", "mali", "malta", "marshall islands", "mauritania", "mauritius", "mexico", "micronesia",
    "moldova", "monaco", "mongolia", "montenegro", "morocco", "mozambique", "myanmar", "namibia", "nauru",
    "nepal", "netherlands", "new zealand", "nicaragua", "niger", "nigeria", "north korea", "north macedonia",
    "norway", "oman", "pakistan", "palau", "panama", "papua new guinea", "paraguay", "peru", "philippines",
    "poland", "portugal", "qatar", "romania", "russia", "rwanda", "saint kitts and nevis", "saint lucia",
    "saint vincent and the grenadines", "samoa", "san marino", "sao tome and principe", "saudi arabia",
    "senegal", "serbia", "seychelles", "sierra leone", "singapore", "slovakia", "slovenia",
    "solomon islands", "somalia", "south africa", "south korea", "south sudan", "spain", "sri lanka",
    "sudan", "suriname", "sweden", "switzerland", "syria", "taiwan", "tajikistan", "tanzania", "thailand",
    "timor-leste", "togo", "tonga", "trinidad and tobago", "tunisia", "turkey", "turkmenistan", "tuvalu",
    "uganda", "ukraine", "united arab emirates", "united kingdom", "united states", "uruguay", "uzbekistan",
    "vanuatu", "vatican city", "venezuela", "vietnam", "yemen", "zambia", "zimbabwe",
]

VAGUE_PLACES = COARSE_PLACES + US_STATES + UK_COUNTIES + INDIAN_STATES + COUNTRIES

# substrings that mark a broad place label
BROAD_PLACE_HINTS = [
    "ocean", "sea", "coast", "peninsula", "kingdom", "region", "empire", "continent", "territory",
    "province", "state", "islands", "archipelago",
]

# substrings that mark an uncertain place label
UNCERTAIN_LABEL_HINTS = [
    "unnamed", "unknown", "various", "multiple", "mixed", "unspecified",
]

# city spellings looked for in titles -> canonical city
TITLE_CITY_ALIASES = {
    "bombay": "mumbai",
    "mumbai": "mumbai",
    "constantinople": "istanbul",
    "istanbul": "istanbul",
    "new york city": "new york",
    "new york": "new york",
}

# inhabitants named in titles -> canonical city
CITY_DEMONYMS = {
    "dubliners": "dublin",
    "londoners": "london",
    "parisians": "paris",
    "new yorker": "new york",
    "new yorkers": "new york",
}

# city spellings in contributed sheets -> display name; first hit wins
SHEET_CITY_ALIASES = {
    "Bombay": "Mumbai",
    "Calcutta": "Kolkata",
    "Kolkata/ Calcutta": "Kolkata",
    "Kolkata/Calcutta": "Kolkata",
    "Madras": "Chennai",
    "Bengaluru": "Bangalore",
    "New Delhi": "Delhi",
    "Vizag": "Visakhapatnam",
}

# former place name -> present name
HISTORICAL_NAMES = {
    "bombay": "Mumbai",
    "madras": "Chennai",
    "calcutta": "Kolkata",
    "poona": "Pune",
    "benares": "Varanasi",
    "cawnpore": "Kanpur",
    "pondicherry": "Puducherry",
    "baroda": "Vadodara",
    "trivandrum": "Thiruvananthapuram",
    "cochin": "Kochi",
    "ceylon": "Sri Lanka",
    "burma": "Myanmar",
    "siam": "Thailand",
    "persia": "Iran",
    "peking": "Beijing",
    "canton": "Guangzhou",
    "saigon": "Ho Chi Minh City",
    "constantinople": "Istanbul",
    "leningrad": "Saint Petersburg",
    "stalingrad": "Volgograd",
    "rhodesia": "Zimbabwe",
    "zaire": "Democratic Republic of the Congo",
    "east pakistan": "Bangladesh",
}

# present city name -> other names searched in catalogues
CATALOGUE_ALIASES = {
    "Mumbai": ["Bombay"],
    "Kolkata": ["Calcutta"],
    "Chennai": ["Madras"],
    "Bangalore": ["Bengaluru"],
    "Varanasi": ["Benaras", "Banaras", "Kashi"],
    "Kochi": ["Cochin"],
    "Pune": ["Poona"],
    "Mysore": ["Mysuru"],
    "St Petersburg": ["Leningrad", "Saint Petersburg"],
    "Istanbul": ["Constantinople"],
    "Srinagar": ["Kashmir"],
    "Ho Chi Minh City": ["Saigon"],
    "Beijing": ["Peking"],
}

# city names compared between title and place
TITLE_CITY_TOKENS = [
    "london", "paris", "istanbul", "dublin", "tokyo", "mumbai", "delhi", "new york", "los angeles", "berlin",
    "rome", "madrid", "moscow",
]

# seed cities: name, lon, lat, region, country
SEED_CITIES = [
    ["Mumbai", "72.8777", "19.076", "South Asia", "India"],
    ["Delhi", "77.209", "28.6139", "South Asia", "India"],
    ["Kolkata", "88.3639", "22.5726", "South Asia", "India"],
    ["Chennai", "80.2707", "13.0827", "South Asia", "India"],
    ["Bangalore", "77.5946", "12.9716", "South Asia", "India"],
    ["Hyderabad", "78.4867", "17.385", "South Asia", "India"],
    ["Jaipur", "75.7873", "26.9124", "South Asia", "India"],
    ["Lucknow", "80.9462", "26.8467", "South Asia", "India"],
    ["Varanasi", "83.0007", "25.3176", "South Asia", "India"],
    ["Goa", "74.124", "15.2993", "South Asia", "India"],
    ["Kochi", "76.2673", "9.9312", "South Asia", "India"],
    ["Pune", "73.8567", "18.5204", "South Asia", "India"],
    ["Ahmedabad", "72.5714", "23.0225", "South Asia", "India"],
    ["Amritsar", "74.8723", "31.634", "South Asia", "India"],
    ["Shimla", "77.1734", "31.1048", "South Asia", "India"],
    ["Mysore", "76.6394", "12.2958", "South Asia", "India"],
    ["Lahore", "74.3587", "31.5204", "South Asia", "Pakistan"],
    ["Karachi", "67.0011", "24.8607", "South Asia", "Pakistan"],
    ["Islamabad", "73.0479", "33.6844", "South Asia", "Pakistan"],
    ["Dhaka", "90.4125", "23.8103", "South Asia", "Bangladesh"],
    ["Colombo", "79.8612", "6.9271", "South Asia", "Sri Lanka"],
    ["Kathmandu", "85.324", "27.7172", "South Asia", "Nepal"],
    ["Patna", "85.1376", "25.6093", "South Asia", "India"],
    ["Srinagar", "74.7973", "34.0837", "South Asia", "India"],
    ["Darjeeling", "88.2631", "27.036", "South Asia", "India"],
    ["Mussoorie", "78.0644", "30.4598", "South Asia", "India"],
    ["Gorakhpur", "83.3732", "26.7606", "South Asia", "India"],
    ["Aligarh", "78.088", "27.8974", "South Asia", "India"],
    ["Bhopal", "77.4126", "23.2599", "South Asia", "India"],
    ["Shillong", "91.8933", "25.5788", "South Asia", "India"],
    ["Kalimpong", "88.47", "27.066", "South Asia", "India"],
    ["Jaisalmer", "70.9083", "26.9157", "South Asia", "India"],
    ["Jodhpur", "73.0243", "26.2389", "South Asia", "India"],
    ["Pondicherry", "79.8083", "11.9416", "South Asia", "India"],
    ["Agra", "78.0081", "27.1767", "South Asia", "India"],
    ["Dehradun", "78.0322", "30.3165", "South Asia", "India"],
    ["Udaipur", "73.7125", "24.5854", "South Asia", "India"],
    ["Madurai", "78.1198", "9.9252", "South Asia", "India"],
    ["Dharamshala", "76.3234", "32.219", "South Asia", "India"],
    ["Kabul", "69.1723", "34.5281", "South Asia", "Afghanistan"],
    ["Kozhikode", "75.7804", "11.2588", "South Asia", "India"],
    ["Aizawl", "92.7176", "23.7271", "South Asia", "India"],
    ["London", "-0.1276", "51.5074", "Europe", "UK"],
    ["Paris", "2.3522", "48.8566", "Europe", "France"],
    ["Dublin", "-6.2603", "53.3498", "Europe", "Ireland"],
    ["New York", "-74.006", "40.7128", "North America", "USA"],
    ["Istanbul", "28.9784", "41.0082", "Europe", "Turkey"],
    ["Cairo", "31.2357", "30.0444", "Middle East", "Egypt"],
    ["Tokyo", "139.6917", "35.6895", "East Asia", "Japan"],
    ["Kyoto", "135.7681", "35.0116", "East Asia", "Japan"],
    ["Seoul", "126.978", "37.5665", "East Asia", "South Korea"],
    ["Beijing", "116.4074", "39.9042", "East Asia", "China"],
    ["Shanghai", "121.4737", "31.2304", "East Asia", "China"],
    ["Hong Kong", "114.1694", "22.3193", "East Asia", "China"],
    ["Bangkok", "100.5018", "13.7563", "Southeast Asia", "Thailand"],
    ["Singapore", "103.8198", "1.3521", "Southeast Asia", "Singapore"],
    ["Lagos", "3.3792", "6.5244", "Africa", "Nigeria"],
    ["Johannesburg", "28.0473", "-26.2041", "Africa", "South Africa"],
    ["Accra", "-0.187", "5.6037", "Africa", "Ghana"],
    ["Dar es Salaam", "39.2083", "-6.7924", "Africa", "Tanzania"],
    ["Buenos Aires", "-58.3816", "-34.6037", "Latin America", "Argentina"],
    ["Mexico City", "-99.1332", "19.4326", "Latin America", "Mexico"],
    ["Rio de Janeiro", "-43.1729", "-22.9068", "Latin America", "Brazil"],
    ["Havana", "-82.3666", "23.1136", "Latin America", "Cuba"],
    ["Moscow", "37.6173", "55.7558", "Europe", "Russia"],
    ["Rome", "12.4964", "41.9028", "Europe", "Italy"],
    ["Vienna", "16.3738", "48.2082", "Europe", "Austria"],
    ["Amsterdam", "4.9041", "52.3676", "Europe", "Netherlands"],
    ["Berlin", "13.405", "52.52", "Europe", "Germany"],
    ["Prague", "14.4378", "50.0755", "Europe", "Czech Republic"],
    ["Barcelona", "2.1734", "41.3851", "Europe", "Spain"],
    ["Lisbon", "-9.1393", "38.7223", "Europe", "Portugal"],
    ["Edinburgh", "-3.1883", "55.9533", "Europe", "UK"],
    ["Manchester", "-2.2426", "53.4808", "Europe", "UK"],
    ["Chicago", "-87.6298", "41.8781", "North America", "USA"],
    ["Los Angeles", "-118.2437", "34.0522", "North America", "USA"],
    ["San Francisco", "-122.4194", "37.7749", "North America", "USA"],
    ["Tehran", "51.389", "35.6892", "Middle East", "Iran"],
    ["Baghdad", "44.3661", "33.3152", "Middle East", "Iraq"],
    ["Beirut", "35.5018", "33.8938", "Middle East", "Lebanon"],
    ["Jerusalem", "35.2137", "31.7683", "Middle East", "Israel"],
    ["Alexandria", "29.9187", "31.2001", "Middle East", "Egypt"],
    ["Nairobi", "36.8219", "-1.2921", "Africa", "Kenya"],
    ["St Petersburg", "30.3351", "59.9343", "Europe", "Russia"],
    ["Sydney", "151.2093", "-33.8688", "Oceania", "Australia"],
    ["Melbourne", "144.9631", "-37.8136", "Oceania", "Australia"],
    ["Toronto", "-79.3832", "43.6532", "North America", "Canada"],
    ["Montreal", "-73.5673", "45.5017", "North America", "Canada"],
    ["Stockholm", "18.0686", "59.3293", "Europe", "Sweden"],
    ["Copenhagen", "12.5683", "55.6761", "Europe", "Denmark"],
    ["Oslo", "10.7522", "59.9139", "Europe", "Norway"],
    ["Warsaw", "21.0122", "52.2297", "Europe", "Poland"],
    ["Budapest", "19.0402", "47.4979", "Europe", "Hungary"],
    ["Athens", "23.7275", "37.9838", "Europe", "Greece"],
    ["Madrid", "-3.7038", "40.4168", "Europe", "Spain"],
    ["Ho Chi Minh City", "106.6297", "10.8231", "Southeast Asia", "Vietnam"],
    ["Hanoi", "105.8342", "21.0278", "Southeast Asia", "Vietnam"],
    ["Manila", "120.9842", "14.5995", "Southeast Asia", "Philippines"],
    ["Jakarta", "106.8456", "-6.2088", "Southeast Asia", "Indonesia"],
    ["Addis Ababa", "38.7578", "9.0192", "Africa", "Ethiopia"],
    ["Cape Town", "18.4241", "-33.9249", "Africa", "South Africa"],
    ["Casablanca", "-7.5898", "33.5731", "Africa", "Morocco"],
    ["Lima", "-77.0428", "-12.0464", "Latin America", "Peru"],
    ["Bogota", "-74.0721", "4.711", "Latin America", "Colombia"],
    ["Santiago", "-70.6693", "-33.4489", "Latin America", "Chile"],
    ["Taipei", "121.5654", "25.033", "East Asia", "Taiwan"],
]

# known coordinates of contributed places, in search order: name, lon, lat
KNOWN_PLACES = [
    ["Delhi", "77.209", "28.6139"],
    ["New Delhi", "77.209", "28.6139"],
    ["Mumbai", "72.8777", "19.076"],
    ["Bombay", "72.8777", "19.076"],
    ["Kolkata", "88.3639", "22.5726"],
    ["Calcutta", "88.3639", "22.5726"],
    ["Chennai", "80.2707", "13.0827"],
    ["Madras", "80.2707", "13.0827"],
    ["Bangalore", "77.5946", "12.9716"],
    ["Bengaluru", "77.5946", "12.9716"],
    ["Hyderabad", "78.4867", "17.385"],
    ["Jaipur", "75.7873", "26.9124"],
    ["Lucknow", "80.9462", "26.8467"],
    ["Varanasi", "83.0007", "25.3176"],
    ["Goa", "74.124", "15.2993"],
    ["Kochi", "76.2673", "9.9312"],
    ["Pune", "73.8567", "18.5204"],
    ["Ahmedabad", "72.5714", "23.0225"],
    ["Amritsar", "74.8723", "31.634"],
    ["Shimla", "77.1734", "31.1048"],
    ["Mysore", "76.6394", "12.2958"],
    ["Lahore", "74.3587", "31.5204"],
    ["Karachi", "67.0011", "24.8607"],
    ["Islamabad", "73.0479", "33.6844"],
    ["Dhaka", "90.4125", "23.8103"],
    ["Colombo", "79.8612", "6.9271"],
    ["Kathmandu", "85.324", "27.7172"],
    ["Kabul", "69.1723", "34.5281"],
    ["Patna", "85.1376", "25.6093"],
    ["Srinagar", "74.7973", "34.0837"],
    ["Darjeeling", "88.2631", "27.036"],
    ["Mussoorie", "78.0644", "30.4598"],
    ["Aligarh", "78.088", "27.8974"],
    ["Gorakhpur", "83.3732", "26.7606"],
    ["Shillong", "91.8933", "25.5788"],
    ["Jodhpur", "73.0243", "26.2389"],
    ["Kalimpong", "88.47", "27.066"],
    ["Jaisalmer", "70.9083", "26.9157"],
    ["Agra", "78.0081", "27.1767"],
    ["Bhopal", "77.4126", "23.2599"],
    ["Chandigarh", "76.7794", "30.7333"],
    ["Coimbatore", "76.9558", "11.0168"],
    ["Dehradun", "78.0322", "30.3165"],
    ["Indore", "75.8577", "22.7196"],
    ["Kanpur", "80.3319", "26.4499"],
    ["Madurai", "78.1198", "9.9252"],
    ["Mangalore", "74.856", "12.9141"],
    ["Nagpur", "79.0882", "21.1458"],
    ["Pondicherry", "79.8083", "11.9416"],
    ["Thiruvananthapuram", "76.9366", "8.5241"],
    ["Udaipur", "73.7125", "24.5854"],
    ["Vizag", "83.2185", "17.6868"],
    ["Visakhapatnam", "83.2185", "17.6868"],
    ["Andhra Pradesh", "79.74", "15.9129"],
    ["Mukteshwar", "79.65", "29.47"],
    ["Dhanbad", "86.43", "23.7957"],
    ["Barasat", "88.48", "22.7235"],
    ["Bhubaneswar", "85.8245", "20.2961"],
    ["Puri", "85.8315", "19.8135"],
    ["Banaras", "83.0007", "25.3176"],
    ["Aizawl", "92.7176", "23.7271"],
    ["Dajeeling", "88.2631", "27.036"],
    ["Kumaon", "79.65", "29.6"],
    ["Dharamshala", "76.3234", "32.219"],
    ["Kozhikode", "75.7804", "11.2588"],
    ["Mysuru", "76.6394", "12.2958"],
    ["Pasighat", "95.3269", "28.067"],
    ["Belgavi", "74.4977", "15.8497"],
    ["Belgaum", "74.4977", "15.8497"],
    ["Casablanca", "-7.5898", "33.5731"],
    ["Ranaghat", "88.57", "23.18"],
    ["Srikakulam", "83.8961", "18.2949"],
    ["Kattupatti", "77.57", "10.32"],
    ["Kerala", "76.2711", "10.8505"],
    ["Tamil Nadu", "78.6569", "11.1271"],
    ["Karnataka", "75.7139", "15.3173"],
    ["Assam", "92.9376", "26.2006"],
    ["West Bengal", "87.855", "22.9868"],
    ["Bengal", "87.855", "22.9868"],
    ["Nepal", "84.124", "28.3949"],
    ["North Sentinel Island", "92.2333", "11.55"],
    ["Mahe", "75.5354", "11.7005"],
    ["Karikkottakkari", "75.37", "11.87"],
    ["Mandavgarh Fort", "75.399", "22.205"],
    ["Mandavgarh", "75.399", "22.205"],
    ["Bangarwadi", "74.48", "18.96"],
    ["Palasgaon", "75.92", "19.54"],
    ["Kija", "94.26", "25.58"],
    ["Gangauli", "83.55", "25.85"],
    ["Atharighat", "92.78", "26.75"],
]

# country -> region
COUNTRY_REGION = {
    "India": "South Asia",
    "Pakistan": "South Asia",
    "Bangladesh": "South Asia",
    "Sri Lanka": "South Asia",
    "Nepal": "South Asia",
    "Afghanistan": "South Asia",
    "Bhutan": "South Asia",
    "Maldives": "South Asia",
    "United Kingdom": "Europe",
    "UK": "Europe",
    "England": "Europe",
    "France": "Europe",
    "Germany": "Europe",
    "Italy": "Europe",
    "Spain": "Europe",
    "Portugal": "Europe",
    "Ireland": "Europe",
    "Russia": "Europe",
    "Turkey": "Middle East",
    "United States": "North America",
    "USA": "North America",
    "Canada": "North America",
    "Mexico": "Latin America",
    "Brazil": "Latin America",
    "Argentina": "Latin America",
    "Japan": "East Asia",
    "China": "East Asia",
    "South Korea": "East Asia",
    "Thailand": "Southeast Asia",
    "Singapore": "Southeast Asia",
    "Indonesia": "Southeast Asia",
    "Egypt": "Middle East",
    "Iran": "Middle East",
    "Iraq": "Middle East",
    "Lebanon": "Middle East",
    "Israel": "Middle East",
    "Nigeria": "Africa",
    "Kenya": "Africa",
    "South Africa": "Africa",
    "Ghana": "Africa",
    "Tanzania": "Africa",
}

# cities and landscapes looked for in public-domain full texts
FULLTEXT_CITIES = [
    "Mumbai", "Bombay", "Delhi", "Kolkata", "Calcutta", "Chennai", "Madras", "Bangalore", "Bengaluru",
    "Hyderabad", "Jaipur", "Lucknow", "Varanasi", "Benares", "Goa", "Kochi", "Cochin", "Pune", "Poona",
    "Ahmedabad", "Amritsar", "Shimla", "Simla", "Mysore", "Lahore", "Karachi", "Islamabad", "Dhaka", "Dacca",
    "Colombo", "Kathmandu", "Kabul", "London", "Paris", "Dublin", "Moscow", "St Petersburg", "Prague",
    "Istanbul", "Constantinople", "Cairo", "Algiers", "New York", "Boston", "Buenos Aires", "Tokyo", "Lagos",
    "Nairobi", "Ganges", "Ganga", "Himalaya", "Rajasthan", "Kashmir", "Punjab", "Bengal", "Malabar",
    "Deccan",
]


# ---- titles, genres, subjects, languages ----

# title phrases (regex, whole words) of reference works
NONFICTION_TITLE_WORDS = [
    "gazetteer", "census", "survey of", "encyclop(?:a|e)dia", "dictionary", "almanac", "handbook",
    "directory", "bibliography", "proceedings", "journal of", "textbook", "introduction to", "principles of",
    "study guide", "field guide", "travel guide",
]

# novels whose titles look like reference works
NONFICTION_SAFELIST = [
    "a lady cyclist's guide to kashgar", "an atlas of impossible longing",
    "the brief wondrous life of oscar wao", "a brief history of seven killings", "a dictionary of maqiao",
    "the future dictionary of america", "almanac of the dead", "principles of prediction",
    "the patna manual of style",
]

# titles too generic to identify a work
GENERIC_TITLES = [
    "poems", "selected works", "diary", "fragments", "letters", "complete works", "collected", "works",
    "songs", "verses",
]

# genres that settle that a work is fiction
FICTION_GENRES = [
    "literary fiction", "historical fiction", "mystery", "crime", "romance", "thriller", "horror", "fantasy",
    "satire", "short stories", "magical realism", "science fiction", "young adult", "postcolonial",
    "political fiction", "children's",
]

# title phrases (whole words) of reports and studies, in test order
REPORT_TITLE_WORDS = [
    r"\breport\b",
    r"\bsurvey\b",
    r"\bcensus\b",
    r"\bgazetteer\b",
    r"\bmanual\b",
    r"\bhandbook\b",
    r"\bencyclopedia\b",
    r"\batlas\b",
    r"\badministration\b",
    r"\bhistory of\b",
    r"\ba history\b",
    r"\bcastes and tribes\b",
    r"\bpopulation\b",
    r"\bsocio-ecological\b",
    r"\bskill survey\b",
    r"\barea skill\b",
    r"\bhealth officer\b",
    r"\bmedical officer\b",
    r"\btax administration\b",
    r"\bdistrict gazetteer\b",
    r"\bdistrict manual\b",
    r"\bforestry\b",
    r"\bprison manual\b",
    r"\brevenue\b",
    r"\bcommission of enquiry\b",
    r"\bcommission of inquiry\b",
    r"\bmaradumaśumārī\b",
    r"\bfertility and mortality\b",
]

# description patterns of studies, in test order
REPORT_TEXT_PATTERNS = [
    r'traditions, characteristics\s+and\s+behavi',
    r'this (?:book|volume|study|report) (?:examines|explores|documents|provides)',
    r'a (?:comprehensive|scholarly|detailed) (?:study|analysis|account|survey)',
    r'government\s+(?:report|publication|document)',
]

# titles always kept
KEPT_TITLES = [
    "a lady cyclist's guide to kashgar", "digital fortress", "pygmalion", "an atlas of impossible longing",
    "the nature lover's guide to survival", "the patna manual of style", "the wind-up bird chronicle",
]

# authors always kept
KEPT_AUTHORS = [
    "dan brown", "george bernard shaw", "anuradha roy", "suzanne joinson",
]

# title substrings that the quality report counts as suspect
SUSPECT_TITLE_PARTS = [
    "study guide", "supersummary", "sparknotes", "cliffsnotes", "encyclopedia", "dictionary", "gazetteer",
    "manual", "textbook", "history of",
]

# publishers of study notes
BLOCKED_AUTHOR_PARTS = [
    "supersummary", "sparknotes", "cliffsnotes", "bookrags", "grade saver",
]

# titles of study notes
BLOCKED_TITLE_PARTS = [
    "study guide", "book notes", "summary and analysis", "lesson plan", "exam prep",
]

# subject substrings of reference works
REFERENCE_SUBJECT_PARTS = [
    "guidebooks", "guidebook", "encyclopedias", "encyclopedia", "dictionaries", "dictionary", "bibliography",
    "textbooks", "manuals", "reference", "history", "historical", "gazetteers",
]

# subject substrings of fiction
FICTION_SUBJECT_PARTS = [
    "fiction", "novel", "novels", "short stories", "mystery fiction", "romance fiction", "science fiction",
    "fantasy fiction", "historical fiction", "thrillers",
]

# subject substrings of fiction in the full-text catalogue
FULLTEXT_FICTION_PARTS = [
    "fiction", "novel", "stories", "romance", "adventure", "mystery", "fantasy", "allegory", "tale", "fable",
]

# subject substring -> genre (catalogue ingest)
SUBJECT_GENRES = {
    "fiction": "literary fiction",
    "novel": "literary fiction",
    "historical fiction": "historical fiction",
    "mystery": "mystery",
    "detective": "mystery",
    "crime": "crime",
    "romance": "romance",
    "love stories": "romance",
    "science fiction": "science fiction",
    "fantasy": "fantasy",
    "thriller": "thriller",
    "suspense": "thriller",
    "horror": "horror",
    "poetry": "poetry",
    "short stories": "short stories",
    "memoir": "memoir",
    "autobiography": "memoir",
    "biography": "biography",
    "children": "children's",
    "young adult": "young adult",
    "magic": "magical realism",
    "postcolonial": "postcolonial",
    "satire": "satire",
    "political": "political fiction",
    "social": "social realism",
    "literary": "literary fiction",
}

# subject substring -> theme (catalogue ingest)
SUBJECT_THEMES = {
    "partition": "partition",
    "independence": "independence",
    "colonial": "colonialism",
    "caste": "caste",
    "poverty": "poverty",
    "family": "family",
    "marriage": "marriage",
    "identity": "identity",
    "migration": "migration",
    "immigrant": "diaspora",
    "diaspora": "diaspora",
    "war": "war",
    "revolution": "revolution",
    "religion": "religion",
    "women": "gender",
    "feminist": "gender",
    "race": "race",
    "class": "class",
    "love": "love",
    "death": "mortality",
    "memory": "memory",
    "home": "home",
    "exile": "exile",
    "corruption": "corruption",
    "urban": "urban_life",
    "rural": "rural_life",
    "childhood": "childhood",
}

# subject substring -> genre, first hit per subject (genre extraction)
SUBJECT_GENRES_DETAILED = {
    "detective": "mystery",
    "mystery": "mystery",
    "crime": "crime fiction",
    "thriller": "thriller",
    "suspense": "thriller",
    "horror": "horror",
    "ghost stor": "horror",
    "supernatural": "horror",
    "gothic": "gothic fiction",
    "science fiction": "science fiction",
    "sci-fi": "science fiction",
    "dystopi": "science fiction",
    "utopi": "science fiction",
    "cyberpunk": "science fiction",
    "fantasy": "fantasy",
    "magic": "fantasy",
    "fairy tale": "fantasy",
    "romance": "romance",
    "love stor": "romance",
    "historical fiction": "historical fiction",
    "historical": "historical fiction",
    "war": "war fiction",
    "world war": "war fiction",
    "military": "war fiction",
    "adventure": "adventure",
    "satire": "satire",
    "humor": "humor",
    "humorous": "humor",
    "comic": "humor",
    "coming of age": "coming-of-age",
    "bildungsroman": "coming-of-age",
    "young adult": "young adult",
    "children": "children's",
    "juvenile": "children's",
    "picture book": "children's",
    "autobiography": "autobiography",
    "memoir": "memoir",
    "biography": "biography",
    "travel": "travel writing",
    "philosophical": "philosophical fiction",
    "existential": "philosophical fiction",
    "absurd": "absurdist fiction",
    "magical realism": "magical realism",
    "postmodern": "postmodern fiction",
    "experimental": "experimental fiction",
    "epistolary": "epistolary fiction",
    "noir": "noir",
    "western": "western",
    "spy": "spy fiction",
    "espionage": "spy fiction",
    "political": "political fiction",
    "social": "social realism",
    "realism": "literary fiction",
    "literary": "literary fiction",
    "domestic fiction": "domestic fiction",
    "family": "family saga",
    "saga": "family saga",
    "psychological": "psychological fiction",
    "feminist": "feminist fiction",
    "allegory": "allegory",
    "fable": "fable",
    "short stor": "short stories",
    "poetry": "poetry",
    "drama": "drama",
    "play": "drama",
}

# subjects that say nothing about the genre
IGNORED_SUBJECTS = [
    "fiction", "novel", "novels", "literature", "english literature", "american literature",
    "french literature", "german literature", "accessible book", "protected daisy", "in library",
    "overdrive", "lending library", "large type books", "open library staff picks",
    "new york times bestseller", "reading level", "nyt:combined-print-and-e-book-fiction",
]

# form of a contributed work (substring) -> genres, first hit wins
FORM_GENRES = {
    "novel": ["literary fiction"],
    "novella": ["literary fiction", "novella"],
    "short stor": ["short stories"],
    "poem": ["poetry"],
    "graphic novel": ["graphic novel"],
    "memoir": ["memoir"],
    "essay": ["essay"],
    "historical fiction": ["historical fiction"],
    "anthology": ["anthology"],
    "stories": ["short stories"],
}

# language label -> clean label
LANGUAGE_LABELS = {
    "american english": "English",
    "british english": "English",
    "eng": "English",
    "en": "English",
    "unknown": "Unknown",
}

# catalogue language code -> language
LANGUAGE_CODES = {
    "eng": "English",
    "hin": "Hindi",
    "urd": "Urdu",
    "ben": "Bengali",
    "tam": "Tamil",
    "tel": "Telugu",
    "mar": "Marathi",
    "fre": "French",
    "ger": "German",
    "spa": "Spanish",
    "rus": "Russian",
    "jpn": "Japanese",
    "ara": "Arabic",
    "por": "Portuguese",
    "tur": "Turkish",
    "ita": "Italian",
}

# substring of a sheet's language -> language, first hit wins
LANGUAGE_PARTS = {
    "english": "English",
    "hindi": "Hindi",
    "urdu": "Urdu",
    "bengali": "Bengali",
    "bangla": "Bengali",
    "tamil": "Tamil",
    "telugu": "Telugu",
    "marathi": "Marathi",
    "kannada": "Kannada",
    "malayalam": "Malayalam",
    "malaylam": "Malayalam",
    "odia": "Odia",
    "assamese": "Assamese",
    "konkani": "Konkani",
    "french": "French",
    "rajasthani": "Rajasthani",
}

# cities left out of the small-town list
METROS = [
    "Mumbai", "Delhi", "Kolkata", "Chennai", "Bangalore", "Hyderabad", "London", "New York", "Paris",
    "Tokyo", "Karachi", "Lahore", "Dhaka", "Moscow",
]


# ---- themes and emotions ----

# themes that say little
GENERIC_THEMES = [
    "class", "war", "home", "identity", "society", "life", "love", "history", "mortality", "power",
]

# stock themes of two much-written cities
STEREOTYPE_THEMES = [
    "orientalist_fantasy", "harem_mythology", "imperial_nostalgia", "salon_decadence", "bourgeois_decay",
]

# places those themes cling to
STEREOTYPED_CITIES = [
    "paris", "istanbul",
]

# title substrings of adventure books
ADVENTURE_TITLE_PARTS = [
    "tarzan", "quest", "jungle", "expedition", "treasure", "adventure",
]

# themes expected of adventure books
ADVENTURE_THEMES = [
    "civilization_versus_wilderness", "wilderness_survival", "identity_reclamation", "adventure_quest",
    "colonial_adventure",
]

# title substrings of collected works
COLLECTED_TITLE_PARTS = [
    "works", "volumes", "collected", "complete",
]

# themes expected of collected works
COLLECTED_THEMES = [
    "gothic_psychology", "analytic_detection", "macabre_symbolism", "metaphysical_horror",
]

# theme substrings of a city view
CITY_LENS_PARTS = [
    "salon", "orientalist", "harem", "imperial", "bohemian", "aristocratic", "bourgeois", "metropolis",
    "urban",
]

# themes forced for a title
TITLE_THEMES = {
    "good omens": ["bureaucratic_absurdity", "cosmic_indifference", "apocalyptic_farce"],
    "coraline": ["uncanny_doubling", "childhood_courage", "predatory_domestic_fantasy"],
    "bridget jones's diary": ["self_deprecating_humor", "urban_dating_anxiety", "media_workplace_precarity"],
    "stardust": ["threshold_crossing", "fallen_star_quest", "faerie_realm_bargains"],
    "dubliners": ["dublin_social_paralysis", "epiphanic_stasis", "irish_civic_stagnation"],
    "ficciones": ["metaphysical_labyrinths", "infinite_textuality", "epistemic_paradox"],
    "nine stories": ["postwar_psychological_fragility", "alienation_in_affluence", "moral_disquiet"],
    "the curious incident of the dog in the night-time": ["neurodivergent_cognition", "forensic_literalism", "family_trust_breakdown"],
}

# filler themes of an early enrichment run
FILLER_THEMES = [
    "social_constraint", "identity_negotiation", "setting_driven_narrative", "urban_or_regional_memory",
    "place_conditioned_experience", "memory_of_place", "belonging_and_exile", "tradition_vs_modernity",
    "cultural_tension", "social_hierarchy", "modernity_anxiety",
]

# theme words without a concrete sense
ABSTRACT_TOKENS = [
    "identity", "negotiation", "social", "constraint", "experience", "setting", "driven", "narrative",
    "memory", "belonging", "exile", "tradition", "modernity", "tension", "hierarchy", "anxiety", "guilt",
    "decay", "integrity", "protocol", "conditioned", "place", "urban", "regional",
]

# theme words that name something concrete
ANCHOR_TOKENS = [
    "labor", "worker", "workers", "textile", "plantation", "concubinage", "caste", "refugee", "migration",
    "diaspora", "investigation", "serial", "killer", "crime", "police", "court", "prison", "war",
    "insurgency", "military", "surveillance", "bureaucratic", "bureaucracy", "school", "university",
    "marriage", "family", "housing", "tenancy", "slum", "agrarian", "farm", "river", "sea", "forest",
    "village", "city", "underworld", "religious", "sectarian", "colonial", "imperial", "drought", "famine",
    "pandemic", "epidemic",
]

# theme words that name what happens to people
ABSTRACTION_TOKENS = [
    "oppression", "exploitation", "transformation", "disintegration", "alienation", "displacement",
    "marginalization", "radicalization", "surveillance", "resistance", "trauma", "memory", "conflict",
    "violence", "coercion", "precarity", "mobility", "stagnation", "solidarity", "fragmentation",
    "stratification", "erasure", "agency", "identity", "exile", "belonging",
]

# last words of constructed themes
ORNAMENTAL_ENDINGS = [
    "protocol", "integrity", "experience", "narrative", "memory", "condition",
]

# genre or title words of humour
HUMOR_WORDS = [
    "comedy", "satire", "humor", "humorous", "comic",
]

# emotions expected of humour
PLAYFUL_EMOTIONS = [
    "mischief", "playfulness", "jubilation", "intoxication",
]

# genre words of children's books
CHILDREN_WORDS = [
    "children", "childrens", "juvenile", "picture", "middle grade",
]

# emotions odd for children's books
DARK_EMOTIONS = [
    "paranoia", "brutality", "revulsion", "desolation", "suffocation",
]

# emotion spelling -> emotion
EMOTION_ALIASES = {
    "obsessions": "obsession",
    "eerie": "eeriness",
    "chaotic": "chaos",
}

# anchors of the strict output check
STRICT_ANCHORS = [
    "labor", "worker", "workers", "industry", "court", "police", "plantation", "migration", "school",
    "prison", "union", "war", "insurgency", "surveillance", "bureaucracy", "crime", "religious", "colonial",
    "imperial", "farm", "village", "city", "underworld", "military", "trade", "mining", "railway", "port",
    "textile", "concubinage", "caste", "refugee", "diaspora", "investigation", "serial", "killer",
    "marriage", "family", "housing", "tenancy", "slum", "agrarian", "river", "sea", "forest", "university",
    "drought", "famine", "pandemic", "epidemic", "sectarian", "frontier", "rebellion", "expedition",
    "safari", "detective", "espionage", "smuggling", "piracy", "slavery", "abolition", "apartheid",
    "genocide", "partition", "revolution", "coffee", "oil", "gold", "diamond", "ivory", "rubber", "jungle",
    "desert", "ocean", "charity", "church", "mosque", "temple", "hospital", "orphanage", "embassy",
]

# abstractions of the strict output check
STRICT_ABSTRACTIONS = [
    "oppression", "displacement", "conflict", "alienation", "stratification", "precarity", "trauma",
    "resistance", "marginalization", "erasure", "fragmentation", "violence", "coercion", "stagnation",
    "exploitation", "transformation", "disintegration", "radicalization", "solidarity", "agency",
    "corruption", "disillusionment", "survival", "deception", "ambition", "rivalry", "betrayal", "isolation",
    "confinement", "liberation", "subjugation", "othering", "hierarchy", "hubris", "horror", "dread",
    "obsession", "paranoia", "vengeance", "redemption", "scams",
]

# themes refused when they stand alone
STANDALONE_GENERIC = [
    "identity", "society", "class", "history", "love", "war", "power", "life",
]

# anchors of the relaxed output check
RELAXED_ANCHORS = [
    "labor", "worker", "workers", "industry", "court", "police", "plantation", "migration", "school",
    "prison", "union", "war", "insurgency", "surveillance", "bureaucracy", "crime", "religious", "colonial",
    "imperial", "farm", "village", "city", "underworld", "military", "trade", "mining", "railway", "port",
    "textile", "concubinage", "caste", "refugee", "diaspora", "investigation", "serial", "killer",
    "marriage", "family", "housing", "tenancy", "slum", "agrarian", "river", "sea", "forest", "university",
    "drought", "famine", "pandemic", "epidemic", "sectarian", "frontier", "rebellion", "expedition",
    "safari", "detective", "espionage", "smuggling", "piracy", "slavery", "abolition", "apartheid",
    "genocide", "partition", "revolution", "coffee", "oil", "gold", "diamond", "ivory", "rubber", "jungle",
    "desert", "ocean", "romance", "love", "affair", "wedding", "divorce", "courtship", "infidelity", "widow",
    "urban", "metropolitan", "suburban", "neighborhood", "estate", "manor", "aristocracy", "bourgeois",
    "poverty", "wealth", "class", "society", "salon", "club", "adolescence", "youth", "childhood",
    "boarding", "orphan", "inheritance", "art", "artist", "music", "musician", "theater", "theatre",
    "literary", "writer", "painter", "cinema", "film", "photography", "gallery", "museum", "opera", "ballet",
    "murder", "death", "funeral", "cemetery", "ghost", "haunting", "mystery", "secret", "nature",
    "wilderness", "pastoral", "garden", "park", "mountain", "island", "coast", "journey", "voyage", "travel",
    "train", "ship", "road", "highway", "border", "exile", "shop", "store", "market", "business", "office",
    "factory", "profession", "career", "home", "house", "apartment", "domestic", "kitchen", "bedroom",
    "attic", "basement", "church", "temple", "mosque", "monastery", "convent", "priest", "spiritual",
    "ritual", "hospital", "asylum", "illness", "madness", "addiction", "body", "aging", "postwar", "prewar",
    "century", "era", "period", "generation", "memory",
]

# abstractions of the relaxed output check
RELAXED_ABSTRACTIONS = [
    "oppression", "displacement", "conflict", "alienation", "stratification", "precarity", "trauma",
    "resistance", "marginalization", "erasure", "fragmentation", "violence", "coercion", "stagnation",
    "exploitation", "transformation", "disintegration", "radicalization", "solidarity", "agency",
    "corruption", "disillusionment", "survival", "deception", "ambition", "rivalry", "betrayal", "isolation",
    "confinement", "liberation", "subjugation", "othering", "hierarchy", "hubris", "longing", "yearning",
    "nostalgia", "melancholy", "anxiety", "obsession", "desire", "passion", "grief", "loss", "regret",
    "guilt", "shame", "fear", "dread", "terror", "hope", "despair", "tension", "struggle", "injustice",
    "inequality", "discrimination", "prejudice", "conformity", "rebellion", "defiance", "subversion",
    "transgression", "scandal", "hypocrisy", "morality", "identity", "selfhood", "belonging", "rootlessness",
    "authenticity", "reinvention", "discovery", "intimacy", "estrangement", "reconciliation", "forgiveness",
    "resentment", "jealousy", "devotion", "decay", "decline", "erosion", "renewal", "rebirth", "continuity",
    "rupture", "transition",
]

# emotion lexicon, in tie order
EMOTION_WORDS = {
    "joy": ["happy", "joy", "delight", "laughter", "cheerful", "bright", "warm", "beautiful", "love", "peace"],
    "sadness": ["sad", "grief", "sorrow", "tears", "mourn", "loss", "lonely", "melancholy", "despair", "weep"],
    "fear": ["fear", "terror", "dread", "horror", "panic", "anxiety", "frightened", "dark", "shadow", "menace"],
    "anger": ["anger", "rage", "fury", "violent", "hate", "bitter", "cruel", "destroy", "burn", "wrath"],
    "nostalgia": ["remember", "memory", "childhood", "once", "used to", "long ago", "past", "return", "home", "forgotten"],
    "wonder": ["wonder", "awe", "magnificent", "vast", "infinite", "magical", "enchanted", "extraordinary", "miracle"],
    "longing": ["longing", "yearning", "desire", "ache", "wish", "miss", "distant", "far", "horizon", "dream"],
}
