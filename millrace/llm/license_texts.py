"""SHA-256 of the canonical form (license_scan.canonical_text) of whole licence texts, by SPDX identifier.

Made from licence files as Debian, the Rust documentation and package authors ship them, with and
without title and appendix. They depend on SPELLINGS and COPYRIGHT: where those change, the
digests must be made anew; test_license_forms compares some.
"""

TEXTS = [
    ("Apache-2.0", "7869c69e2c7722fe91fc22242978e63cba696d807ad8eba171823cdf332386e8"),
    ("Apache-2.0", "f74a128e2a90107b0ec49c89431429c15fd87e24827c6f459a0d3c55737e0cab"),
    ("Apache-2.0", "35cddd25fcf047c8ed02e7f50a2b8a1e824317bf88285754dfe0eb4803ee3050"),
    ("GPL-1.0", "40b4f7a668d0b82810cafd55370a78a5244878534ec56cbbc8fcb980b454fbda"),
    ("GPL-1.0", "cfe57f5c9718709211bfbd1b1828ed9422b0eae1db40a8dc14135f7d5dc9e603"),
    ("GPL-1.0", "5e92bf722d3022b6e08ec5e839afe1a3363db73b5a7f0d1cc9c0fab5e2502f35"),
    ("GPL-2.0", "a6c13c83e69bb869b8612784042981280298b2cebb96875a65efcdc735dafec2"),
    ("GPL-2.0", "5fe0570424a4f3872cf804d2a778b5a4b5cd335b2295807432d20c3c45c0e38c"),
    ("GPL-2.0", "83a5aa7debd796b5db27be062c58544abee7d73850d5b5b690d937e3658bb3dd"),
    ("GPL-2.0", "bf01b0fe3ac6416f3fcaef24b0b528fd08af6f60f58849c1480c07e92c35fc86"),
    ("GPL-2.0", "bd8bd0aa099db6c0ab0dd15564885fb19df7bfdc1a5137aea45b162898ff2fbb"),
    ("GPL-2.0", "2f6b5837589388ad7a482f0485b4e6012d3cc334876b36cc4e77d041887d8036"),
    ("GPL-3.0", "97c6d1fdd515be810982b0982b0eef7ade7740e4a2bdacb1a990d14d95e1de17"),
    ("GPL-3.0", "dbc32f7a1953bac03d090368da93d503985e50cd6f855e2ca2575c638ba31c9e"),
    ("GPL-3.0", "1c3ca0ab23d42d6fe52b411c49c2e2c0ee4eb65d98be98c9439bda7ddcf280ec"),
    ("LGPL-2.0", "63b2f4247e8d9dcb03c1a56ad25f91c39050cf00ca1d4ee81a32be7e8c801bdb"),
    ("LGPL-2.0", "1db0c3363d11d7719baaa95a8861ca62fca5b13ac363ad7b736a8c357ff777b8"),
    ("LGPL-2.0", "6a00f97ac0c23d0950ed43d6f3174069cd58df743c8133501d4ae6dd3820779a"),
    ("LGPL-2.1", "f2e54490a112f1bcbda7acb2aa3b87904a21a100ed46f5c60e62941f68772f5b"),
    ("LGPL-2.1", "c8a6f1cdaeca56e480b354de78b9d5e39734a0c6fb08be8de5950515e8d0f14d"),
    ("LGPL-2.1", "3698ab16c45480d7135faf0a52db84c6834821daf0d50a38c39fc98e7dbd322e"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("GFDL-1.2", "f39b5383e8a3c103cb156c1381fbcdf267128b7d1b7b7c88e784655f007204b3"),
    ("GFDL-1.3", "212a37e81d291f0c8c886ffc33a3c0a0e4c8cc1316c358e0f3a4f155136a65c3"),
    ("MPL-1.1", "df038d717217861fc8c486cce8c32d945c035e65bd8a1486f2cd489d4994722c"),
    ("MPL-2.0", "6a5dcd2c7d384f389a8bcae9a546cfdc6ca1a2a5d7d06473212f48dc6fc981e8"),
    ("CC0-1.0", "ea632f41833cbfc31b72ee97996336ad96f978913868abbb9e9b06cb26a050f7"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("CC-BY-SA-4.0", "6b1132b6c0bd4b0a5ca2e6a35472a79aeeb68fcf49f6c3412900accdb57e9e6d"),
    ("ISC", "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee"),
    ("ISC", "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("MIT", "46559ac7233556b376cbaed5c820190eaf6a55b1cf4860d0649c94a1a5b46a62"),
    ("MIT", "ae07d51685858807a548c3cce7bef8714e6fd80383476d40e472a9efe9b92f5c"),
    ("MIT", "9476b3cc49261c3e5e7a51c5772fcf66abe882a9a6170baf891e12184badea3b"),
    ("MIT", "b394918a083200adf8c5061924bc22de28062756b62d30b8e876d73b78acef8e"),
    ("MIT", "cd9e55d33a3e50219bcc5be28f9d7a57462cb6bb9e167e023f6400aac79376ed"),
    ("NCSA", "6913cbaa86ba6f6211a99828e7002927d8fd1600ef6aa652a56c49e99ab76973"),
    ("OFL-1.1", "ab8bd3ac4d0231e64821c1f534fa52000e4b40bdf6b8ba8652e8e3dd884c1c6c"),
    ("Unicode-3.0", "e88585316e1661f2987da4223f0c554175261880341286b103d4f886fd21cacc"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-2-Clause", "7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2"),
    ("Unlicense", "9e1e88f923b8aacd42ef9a816c77a844bcb48e396b406b79d77672cd77c38889"),
    ("BSL-1.0", "5fcf89bde8c0c2deb999f4cc626e1aebf90e80fdc5cd334dae008152ef4a1ded"),
    ("BSL-1.0", "63f59f97ec9e89acbb1e5578cdcbff8ec71944fceeaaefb7f3531fb7772d40c6"),
    ("Zlib", "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
]
