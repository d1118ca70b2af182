"""A small catalogue of technologies and an extraction schema, in the shapes the operators read."""

CATALOG = {
    "categories": {"1": {"name": "Web servers"}, "2": {"name": "Analytics"}, "3": {"name": "Frameworks"}, "4": {"name": "Languages"}},
    "technologies": {
        "Nginx": {"cats": [1], "website": "https://nginx.org", "headers": {"server": r"nginx(?:/([\d.]+))?\;version:\1"}},
        "Caddy": {"cats": [1], "website": "https://caddyserver.com", "headers": {"server": "^caddy$"}, "implies": "Go"},
        "Apache": {"cats": [1], "website": "https://httpd.apache.org", "headers": {"server": r"apache(?:/([\d.]+))?\;version:\1"}},
        "Go": {"cats": [4], "website": "https://go.dev"},
        "Tracker": {"cats": [2], "website": "", "html": r"track\(\d+\)\;confidence:60"},
        "Cookie Bar": {"cats": [3], "website": "", "html": 'class="cookie-bar"'},
        "Generator": {"cats": [3], "website": "", "meta": {"generator": r"^(\w+)\;version:\1"}},
        "jQuery": {"cats": [3], "website": "https://jquery.com", "scripts": r"jquery[.-]([\d.]+)\;version:\1\;confidence:50"},
    },
}

SCHEMA = {
    "baseSelector": "ul li",
    "multiple": True,
    "fields": [
        {"name": "label", "type": "text"},
        {"name": "href", "type": "attribute", "selector": "a", "attribute": "href", "absolute": True},
        {"name": "linked", "type": "exists", "selector": "a[href]"},
        {"name": "kind", "type": "constant", "value": "item"},
    ],
}
