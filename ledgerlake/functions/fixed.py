"""Fixed values that results depend on."""

#: First topics of event logs.
TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f5514cfc0afda6"
APPROVAL = "0x8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925"
SWAP = "0xc42079f94a6350d7e5735f2a1538197108a858e5111b9ad0a72f5db98e4c0388"
MINT = "0x0f6711612c5b94d76f9d34343434343434343434343434343434343434343434"

ZERO_ADDRESS = "0x" + "0" * 40

#: Labelled senders (the second has 41 characters and matches no address).
FAUCETS = {
    "0x6Cc9397c3B38739daCbfaA18E600263a1174457D": "Alchemy Faucet",
    "0x8ad9277301013d084931fc5ca31787b122fca66": "Infura Faucet",
    "0x4b78662286D9D99772a93c091910609614444444": "RockX Faucet",
    "0x2e6B6A8625686868686868686868686868686868": "Google Faucet",
}

#: Symbols of known token addresses.
SYMBOLS = {
    "0x1c7d4b196cb0c7b01d743fbc6116a902379c7238": "USDC",
    "0xff34b3d4aee8ddcd6f9afffb6fe49bd371b8a357": "DAI",
    "0x7b79995e5f793a07bc00c21412e50ecae098e7f9": "WETH",
    "0xa3382dffca847b84592c05ab05937a1a38623bc": "UNI",
    "0x4200000000000000000000000000000000000006": "WETH",
    "0x7af963cf6d228e964f296a96f3ad97a1ee1bb303": "LINK",
    "0x0000000000000000000000000000000000000000": "ETH",
}

#: The tokens that are watched unless others are named.
WATCHED = [
    "0x1c7D4B196Cb0C7B01d743Fbc6116a902379C7238",
    "0xff34b3d4Aee8ddCd6F9AFFFB6Fe49bD371b8a357",
    "0x7b79995e5f793A07Bc00c21412e50Ecae098E7f9",
    "0xa3382DfFcA847B84592C05AB05937aE1A38623BC",
]

#: What address prefixes tell about a flow, and the tokens that its report names.
FLOW_PREFIXES = [("from", "0x742d", "MEV Bot"), ("from", "0x8787", "Flashloan"), ("from", "0xe592", "Swap"), ("to", "0xe592", "Swap")]
FLOW_TOKENS = {
    "0xA0b86991c6218b36c1d19D4a2e9Eb0cE3606eB48": "USDC",
    "0xdAC17F958D2ee523a2206206994597C13D831ec7": "USDT",
    "0x2260FAC5E5542a773Aa44fBCfeDf7C193bc2C599": "WBTC",
    "0xC02aaA39b223FE8D0A0e5C4F27eAD9083C756Cc2": "WETH",
    "0x6B175474E89094C44Da98b954EedeAC495271d0F": "DAI",
}

#: User agents of programs.
BOTS = r"(?i)(bot|crawler|spider|curl|wget|python|postman)"

#: Names of chains by id.
NETWORKS = {1: "mainnet", 11155111: "sepolia", 17000: "holesky", 31337: "anvil"}
